"""URL filters: rules by host and path, and naive Bayes over segmented words for the rest."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import discard, materialize, small_batches

#: A rule is (host/path prefix, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words whose pages are the first examples of unwanted ones; expectation maximization over all pages then sets the odds.
SEED_WORDS = (
    "adult adserver ads betting bets casino clickbait crack dating escort gambling jackpot keygen loans lottery malware nude payday pharma phishing pills poker porn pornhub replica roulette sex slots spam torrent viagra warez xxx"
).split()
#: Words known besides the corpus', as often as one word in so many.
KNOWN_WORDS = (*SEED_WORDS, *"best buy cash cheap click deal farm fast free game games live online play shop track win".split())
KNOWN_RATE = 20_000
#: Token counts live in so many hash buckets.
BITS = 20
LONGEST = 32
#: After the seed words' first labels, all pages are labelled by the model and counted again so many times.
ROUNDS = 2
#: Soft labels are counted in whole parts of so many, so that sums do not depend on their order.
UNIT = 1024
LETTERS = re.compile(r"[^\W\d_]+")


def host_of(url: Column) -> Column:
    """Between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; empty without a `://`."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the url's or a parent of it, and whose path begins the url's; and its verdict.

    Rules are few and given by the caller; equally long ones are tried in order.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, action in sorted(rules, key=lambda r: len(r[0])):
        own_host, slash, rest = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, action).otherwise(verdict)
    return name, verdict


@dataclass
class UrlModel:
    """Unigram word counts for the segmentation, token log odds for the verdict."""

    words: np.ndarray  # hashes of the words, in order
    counts: np.ndarray
    total: float
    odds: np.ndarray | None = None
    prior: float = 0.0
    extra: dict[str, float] = field(default_factory=dict)
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def plain(self) -> tuple:
        """What executors get: arrays and numbers, no class of this package."""
        return self.words, self.counts, self.total, self.odds, self.prior, self.extra

    def score(self, tokens: list[str]) -> float:
        """Log odds of an unwanted page."""
        return self.prior + float(sum(self.odds[token_bucket(t)] for t in tokens))

    def log_p(self, word: str) -> float:
        h = word_hash(word)
        at = min(int(self.words.searchsorted(h)), len(self.words) - 1)
        n = float(self.counts[at]) if at >= 0 and int(self.words[at]) == h else 0.0
        n = max(n, self.extra.get(word, 0.0))
        if n > 0:
            return math.log(n / self.total)
        return math.log(10.0 / self.total) - len(word) * math.log(10)  # unseen words: rarer with each letter

    def segment(self, run: str) -> tuple[str, ...]:
        """The likeliest split of a run of letters into words of 32 letters at most (Viterbi)."""
        if run not in self.memo:
            best, back = [0.0], [0]
            for j in range(1, len(run) + 1):
                value, i = max((best[i] + self.log_p(run[i:j]), i) for i in range(max(0, j - LONGEST), j))
                best.append(value)
                back.append(i)
            out, j = [], len(run)
            while j:
                out.append(run[back[j] : j])
                j = back[j]
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[run] = tuple(reversed(out))
        return self.memo[run]

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of the host (h:) and path (p:); digits and marks only separate them."""
        return [f"{p}:{w}" for p, part in (("h", host), ("p", path.lower())) for run in LETTERS.findall(part) for w in self.segment(run)]


def token_bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 7) & ((1 << BITS) - 1)


def word_hash(word: str) -> int:
    """Spark's xxhash64 of the word."""
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
    return h if h < 1 << 63 else h - (1 << 64)


def url_parts(pages: DataFrame, url: str) -> DataFrame:
    """Hashes of all strings of 32 letters at most inside the runs of letters of the urls: one column, h."""

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            found = {r for host, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for part in (host, path.lower()) for r in LETTERS.findall(part)}
            yield pa.RecordBatch.from_pydict({"run": pa.array(found, pa.string())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            found = {r[i:j] for r in b.column(0).to_pylist() for i in range(len(r)) for j in range(i + 1, min(i + LONGEST, len(r)) + 1)}
            yield pa.RecordBatch.from_pydict({"h": pa.array([word_hash(w) for w in found], pa.int64())})

    c = F.col(url)
    runs = pages.select(host_of(c).alias("host"), path_of(c).alias("path")).mapInArrow(find_runs, "run string").distinct()
    return runs.mapInArrow(cut, "h bigint").distinct()


def learn(pages: DataFrame, url: str = "url", html: str | None = "html") -> UrlModel:
    """Counts the words of all pages' html (and urls), then the url tokens of wanted and unwanted pages.

    There are no labels, so naive Bayes learns by expectation maximization:
    pages whose segmented url has a seed word are the first unwanted
    examples; then every page counts for both classes by its probability, as
    the model of the round before gives it.  Word counts are exact, and kept
    for the words inside some url; token counts have 2**20 buckets, whatever
    the number of pages.  Urls not among these pages may hold words left out.
    An empty table gives a model that knows the seed words only.
    """
    spark = pages.sparkSession
    text = F.concat_ws(" ", *[F.col(c) for c in (html, url) if c])
    words = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("w")).where(f"w <> '' AND length(w) <= {LONGEST}")
    counts = materialize(words.groupBy("w").agg(F.count("*").alias("n")).select(F.xxhash64("w").alias("h"), "n"), "words")
    total = counts.agg(F.sum("n")).first()[0]
    got = counts.join(url_parts(pages, url), "h", "left_semi").groupBy("h").agg(F.sum("n").alias("n")).toArrow()
    h, n = (got.column(c).to_numpy().astype(np.int64) for c in ("h", "n"))
    order = np.argsort(h)
    model = UrlModel(h[order], n[order], float(total or 1))
    discard(counts)
    model.extra = {w: model.total / KNOWN_RATE for w in KNOWN_WORDS}
    seeds = {f"{p}:{w}" for w in SEED_WORDS for p in "hp"}
    c = F.col(url)
    urls = pages.select(host_of(c).alias("host"), path_of(c).alias("path"))
    for _ in range(1 + ROUNDS):
        sent = spark.sparkContext.broadcast(model.plain())
        n = count_tokens(urls, sent, seeds)
        sent.destroy()
        used = max(1, int((n[:, :-1].sum(0) > 0).sum()))
        log_p = np.log(n[:, :-1] + 1) - np.log(n[:, :-1].sum(1, keepdims=True) + used)
        model.odds = ((log_p[1] - log_p[0]) * (n[:, :-1].sum(0) > 0)).astype(np.float32)
        model.prior = math.log((n[1, -1] + 1) / (n[0, -1] + 1))
    return model


def count_tokens(urls: DataFrame, sent, seeds: set[str]) -> np.ndarray:
    """Counts (wanted, unwanted) of all token buckets, and last of pages, by the model's soft labels or, without odds, by seed words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = UrlModel(*sent.value)
        n = np.zeros((2, (1 << BITS) + 1), np.int64)  # the last place counts pages
        for b in small_batches(batches):
            for host, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = model.tokens(host, path)
                if model.odds is None:
                    bad = UNIT * (not seeds.isdisjoint(tokens))
                else:
                    bad = round(UNIT / (1 + math.exp(-max(-30.0, min(30.0, model.score(tokens))))))
                own = [token_bucket(t) for t in tokens] + [1 << BITS]
                np.add.at(n[0], own, UNIT - bad)
                np.add.at(n[1], own, bad)
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "good": pa.array(n[0, at]), "bad": pa.array(n[1, at])})

    sums = urls.mapInArrow(count, "bucket int, good bigint, bad bigint")
    got = sums.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()  # 2**20 rows at most
    n = np.zeros((2, (1 << BITS) + 1))
    for i, name in enumerate(("good", "bad")):
        n[i, got.column("bucket").to_numpy()] = got.column(name).to_numpy() / UNIT
    return n


def judge(pages: DataFrame, model: UrlModel, url: str = "url", rules=RULES) -> DataFrame:
    """Adds host, path, rule, verdict, words and score to every row.

    The verdict is the longest rule's; where none fits, block if the log odds
    of the url's tokens are above 0 and allow otherwise.  words are the
    host's segmented words.  A null url has an empty host and path and the
    prior's score.  Urls of any length are judged whole; equal rows give
    equal rows; an empty table gives an empty one.  Existing columns of these
    names are replaced.
    """
    spark = pages.sparkSession
    added = ["host", "path", "rule", "verdict", "words", "score"]
    keep = [c for c in pages.columns if c not in added]
    c = F.col(url)
    src = pages.select(*keep, host_of(c).alias("host"), path_of(c).alias("path"))
    name, action = match_rule(F.col("host"), F.col("path"), rules)
    src = src.withColumn("rule", name).withColumn("verdict", action)
    at = src.columns.index("host")
    sent = spark.sparkContext.broadcast(model.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = UrlModel(*sent.value)
        for b in small_batches(batches):
            verdict, words, scores = [], [], []
            for host, path, given in zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist(), b.column(at + 3).to_pylist(), strict=True):
                tokens = m.tokens(host, path)
                score = m.score(tokens)
                scores.append(score)
                words.append(" ".join(t[2:] for t in tokens if t[0] == "h"))
                verdict.append(given or ("block" if score > 0 else "allow"))
            cols = [*b.columns[: at + 3], pa.array(verdict, pa.string()), pa.array(words, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *added])

    return src.mapInArrow(run, src.select("*", F.lit("").alias("words"), F.lit(0.0).alias("score")).schema)
