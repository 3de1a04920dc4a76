"""Personal data: detection and keyed, type-consistent surrogates."""

from __future__ import annotations

import hmac
import ipaddress
import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import small_batches

#: Given names by (script, gender); a name is replaced by another of the same row.
GIVEN_NAMES = {
    ("latin", "f"): "Alice Anna Barbara Carla Carmen Clara Diana Elena Emily Emma Eva Hannah Helen Irene Jane Julia Karen Laura Linda Lisa Lucy Maria Marie Mary Nina Olivia Paula Rosa Sara Sarah Sofia Susan".split(),
    ("latin", "m"): "Adam Albert Andrew Anton Carlos Daniel David Edward Eric Felix Frank George Hans Henry Jack James John Jorge Karl Louis Lucas Mark Martin Michael Oscar Paul Peter Pierre Richard Robert Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Полина Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Владимир Дмитрий Иван Максим Николай Олег Павел Сергей Юрий".split(),
    ("greek", "f"): "Αθηνά Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
TITLES = {"Mr": "m", "Mr.": "m", "Herr": "m", "Señor": "m", "Monsieur": "m", "Sir": "m", "Mrs": "f", "Mrs.": "f", "Ms": "f", "Ms.": "f", "Frau": "f", "Señora": "f", "Madame": "f", "Dr": "", "Dr.": ""}
BY_NAME = {n: key for key, names in GIVEN_NAMES.items() for n in names}

_WORD = r"[^\W\d_]"
_CAP = rf"(?![a-zß-öø-ÿа-яёα-ωάέήίόύώ]){_WORD}{{2,}}(?:-{_WORD}+)?"
#: Well-known shapes of keys: a fixed beginning, then letters and digits.
_token = r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,255}|github_pat_[0-9A-Za-z_]{30,255}|glpat-[0-9A-Za-z_-]{20,64}|sk-[0-9A-Za-z_-]{20,200}|sk_live_[0-9A-Za-z]{16,64}|xox[abeprs]-[0-9A-Za-z-]{10,200}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{10,16000}\.eyJ[0-9A-Za-z_-]{10,16000}\.[0-9A-Za-z_-]{10,16000}"
_name = "|".join(sorted(map(re.escape, BY_NAME), key=len, reverse=True))
_title = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
#: One scan finds all types; earlier alternatives win.
ENTITY = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})"
    rf"|(?P<token>(?<![0-9A-Za-z_-])(?:{_token})(?![0-9A-Za-z_-]))"
    r"|(?P<secret>(?<=[\"'])[0-9a-fA-F]{24,128}(?=[\"'])|(?<![0-9A-Za-z])[0-9a-fA-F]{32,128}(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d))"
    r"|(?P<ip6>(?<![\w:])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=[0-9a-fA-F:]*::)(?=[a-fA-F:]*\d)(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})?::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})?)(?![\w:]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<!\d)\d(?:[ -]?\d){12,18}(?!\d))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|(?<![\w.-])\d{3}[-. ]\d{3}[-. ]\d{4}(?![\w-]))"
    rf"|(?P<person>(?<!\w)(?:(?:{_title}) (?:{_CAP} )?{_CAP}|(?:{_name}) {_CAP}|(?<=name is ){_CAP} {_CAP}|(?<=Name: ){_CAP} {_CAP}|(?<=Dear ){_CAP} {_CAP}|(?<=Contact: ){_CAP} {_CAP}|(?<=Author: ){_CAP} {_CAP}|(?<=Signed, ){_CAP} {_CAP})(?!\w))"
)
#: Every entity holds one of these, so a text without any is spared the scan above.
QUICK = re.compile(rf"@|\d[ .-]?\d|:[0-9a-fA-F:]|[0-9a-fA-F]{{24}}|A[KS]IA|gh[pousr]_|github_pat_|glpat-|sk[-_]|xox|AIza|eyJ|name is |Name: |Dear |Contact: |Author: |Signed, |(?<!\w)(?:{_title}|{_name}) ")


def luhn(digits: str) -> int:
    """The Luhn sum of the digits, modulo 10."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10


def keyed(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), "sha256")[:16], "big")


def walk(key: bytes, label: str, value: int, size: int, back: bool = False) -> int:
    """A keyed permutation of 0..size-1 or its inverse: a Feistel network over two parts of about equal range, walked until inside."""
    high = math.isqrt(max(size - 1, 0)) + 1
    low = -(-size // high)
    while True:
        a, b = divmod(value, low)
        for i in range(5, -1, -1) if back else range(6):
            if i % 2:
                step = wide(key, label, i, a, low)
                b = (b - step if back else b + step) % low
            else:
                step = wide(key, label, i, b, high)
                a = (a - step if back else a + step) % high
        value = a * low + b
        if value < size:
            return value


def wide(key: bytes, label: str, round_: int, value: int, size: int) -> int:
    """A keyed number below size."""
    out = 0
    for i in range(size.bit_length() // 64 + 1):
        out = (out << 128) | keyed(key, label, round_, i, f"{value:x}")
    return out % size


def permute(key: bytes, label: str, value: int, size: int) -> int:
    """A keyed permutation of 0..size-1 that leaves no value in place, if there are two or more."""
    return walk(key, label, (walk(key, label, value, size, True) + 1) % size, size)


DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: Letters are exchanged inside these, so that made names can be spoken.
ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
_CLASS = {c: a for a in ALPHABETS for c in a}


def class_of(c: str) -> str:
    """The letters that may stand for c: of its alphabet, or of the same kind among the 64 code points around it; c alone if it is no letter."""
    if c not in _CLASS:
        kind, first = unicodedata.category(c), ord(c) // 64 * 64
        near = "".join(x for x in map(chr, range(first, first + 64)) if unicodedata.category(x) == kind and x not in "".join(ALPHABETS) and len(x.lower()) == 1)
        _CLASS[c] = near if kind[0] == "L" and c in near else c
    return _CLASS[c]


def exchange(key: bytes, label: str, text: str, class_: Callable[[str], str]) -> str:
    """Permutes all texts of one pattern of classes among themselves; no text with a class of two letters stays.

    The pattern is part of what the permutation depends on, so texts of all
    patterns together are permuted: different texts never meet.
    """
    classes = [class_(c) for c in text]
    size, value = 1, 0
    for c, letters in zip(text, classes, strict=True):
        size, value = size * len(letters), value * len(letters) + letters.index(c)
    if size < 2:
        return text
    value = permute(key, f"{label}\x1e{''.join(letters[0] for letters in classes)}", value, size)
    out = []
    for letters in reversed(classes):
        value, r = divmod(value, len(letters))
        out.append(letters[r])
    return "".join(reversed(out))


def among(*alphabets: str) -> Callable[[str], str]:
    by = {c: a for a in alphabets for c in a}
    return lambda c: by.get(c, c)


def in_place(pattern: str, fresh: str, chars: str) -> str:
    """Puts the fresh characters, in order, where the pattern has characters of `chars`."""
    it = iter(fresh)
    return "".join(next(it) if c in chars else c for c in pattern)


def script_of(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


def like(pattern: str, word: str) -> str:
    """The word in the pattern's letter case, letter by letter where the lengths agree."""
    if len(pattern) == len(word):
        return "".join(w.upper() if p.isupper() and len(w.upper()) == 1 else w for p, w in zip(pattern, word, strict=True))
    return word.upper() if pattern.isupper() and len(pattern) > 1 else word.title() if pattern[:1].isupper() else word


def canonical(kind: str, value: str) -> str:
    """What two mentions of one entity share, whatever their punctuation or letter case."""
    if kind in ("card", "ssn", "iban"):
        return re.sub(r"[ -]", "", value)
    if kind == "phone":
        return ("+" if value.startswith("+") else "") + re.sub(r"\D", "", value)
    if kind in ("email", "secret"):
        return value.lower()
    if kind == "ip6":
        return ipaddress.IPv6Address(value).exploded if is_ip6(value) else value.lower()
    if kind == "person":
        return " ".join(w.lower() for w in value.split(" ") if w not in TITLES)
    return value


def is_ip6(value: str) -> bool:
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return True


def name_part(key: bytes, word: str) -> str:
    """The surrogate of a family name, or of a given name that no list has: the same wherever the word stands."""
    return like(word, exchange(key, "name", word.lower(), class_of))


def given_part(key: bytes, word: str) -> str:
    """The surrogate of a given name: of its list's script and gender, else as name_part(), but never a listed name."""
    own = BY_NAME.get(word.title())
    if own:
        pool = GIVEN_NAMES[own]
        return like(word, pool[permute(key, f"given{own}", pool.index(word.title()), len(pool))])
    out = name_part(key, word)
    while out.title() in BY_NAME:  # walking on keeps different names different
        out = name_part(key, out)
    return out


def surrogate(key: bytes, kind: str, value: str) -> str:
    """The replacement of one mention; it depends on the key and the canonical form only, but for punctuation and case.

    Every kind goes through keyed permutations of the values of its format
    that leave nothing in place, so different entities never meet and none
    stays; a family name has one surrogate, whoever bears it and with or
    without a title or given name.
    """
    canon = canonical(kind, value)
    if kind == "email":
        user, _, host = canon.partition("@")
        plain = lambda c: DIGITS if c in DIGITS else LOWER if c in LOWER else class_of(c)
        last = host.rpartition(".")[2]
        made = f"{exchange(key, 'user', user, plain)}@{exchange(key, 'host', host, plain)}.example.{last if last in ('com', 'org', 'net') else 'org'}"
        return made.upper() if value.isupper() else made
    if kind == "secret":
        made = exchange(key, "hex", canon, among(HEX))
        return made.upper() if value.upper() == value else made
    if kind == "token":
        keep = re.match(r"A[KS]IA|gh[pousr]_|github_pat_|glpat-|sk_live_|sk-|xox.-|AIza|eyJ", value)
        cut = keep.end() if keep else 0
        return value[:cut] + exchange(key, f"token{value[:cut]}", value[cut:], among(DIGITS, LOWER, UPPER))
    if kind == "ip":
        parts = value.split(".")
        if all(int(p) < 256 and str(int(p)) == p for p in parts):
            return str(ipaddress.IPv4Address(permute(key, "ip", int(ipaddress.IPv4Address(value)), 1 << 32)))
        out = exchange(key, "ipx", value, among(DIGITS))
        while all(int(p) < 256 and str(int(p)) == p for p in out.split(".")):  # an address only stands for an address
            out = exchange(key, "ipx", out, among(DIGITS))
        return out
    if kind == "ip6":
        if not is_ip6(value):
            return exchange(key, "ip6", canon, among(HEX))
        made = ipaddress.IPv6Address(permute(key, "ip6", int(ipaddress.IPv6Address(value)), 1 << 128))
        return made.compressed if "::" in value else made.exploded
    if kind == "card":
        body, check = canon[:-1], lambda b: -luhn(b + "0") % 10
        fresh = canon[0] + exchange(key, "card" + canon[0], body[1:], among(DIGITS))
        return in_place(value, f"{fresh}{(check(fresh) + int(canon[-1]) - check(body)) % 10}", DIGITS)  # a valid number stays valid, another invalid
    if kind == "ssn":
        return in_place(value, exchange(key, "ssn", canon, among(DIGITS)), DIGITS)
    if kind == "iban":
        country, body = canon[:2], canon[4:]
        check = lambda b: 98 - int("".join(str(int(c, 36)) for c in b + country + "00")) % 97
        fresh = exchange(key, "iban" + country, body, among(DIGITS, UPPER))
        return in_place(value, f"{country}{(check(fresh) + int(canon[2:4]) - check(body)) % 100:02d}{fresh}", DIGITS + UPPER)
    if kind == "phone":
        digits = canon.lstrip("+")
        head = re.match(r"\+(\d{1,3})(?=\D)", value)
        cut = len(head[1]) if head else 0
        return in_place(value, digits[:cut] + exchange(key, f"phone{digits[:cut]}", digits[cut:], among(DIGITS)), DIGITS)
    words = value.split(" ")
    title = [words.pop(0)] if words[0] in TITLES else []
    return " ".join([*title, *(given_part(key, w) for w in words[:-1]), name_part(key, words[-1])])


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all entities of a text, in order; long numbers that fail the Luhn sum are no cards and stay."""
    if not text or not QUICK.search(text):
        return []
    return [(m.lastgroup or "", m.start(), m.end()) for m in ENTITY.finditer(text) if m.lastgroup != "card" or luhn(canonical("card", m[0])) == 0]


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct entities of all texts with a mention of each: (kind, canon, mention)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            seen: dict[tuple[str, str], str] = {}
            for t in b.column(0).to_pylist():
                for kind, i, j in find(t):
                    c = (kind, canonical(kind, t[i:j]))
                    if c not in seen or t[i:j] < seen[c]:
                        seen[c] = t[i:j]
            yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in seen], pa.string()), "canon": pa.array([c for _, c in seen], pa.string()), "mention": pa.array(list(seen.values()), pa.string())})

    return docs.select(text).mapInArrow(run, "kind string, canon string, mention string").groupBy("kind", "canon").agg(F.min("mention").alias("mention"))


def collisions(docs: DataFrame, key: bytes = b"vicinal", text: str = "text") -> DataFrame:
    """Audit of a corpus: (kind, fresh, n) for surrogates that several entities share or that equal their entity.

    The permutations make it empty; it is a check on that, by one grouped
    count over all distinct entities, and costs a pass over the texts.
    """

    @F.pandas_udf("string")
    def made(kind: pd.Series, mention: pd.Series) -> pd.Series:
        return pd.Series([canonical(k, surrogate(key, k, m)) for k, m in zip(kind, mention, strict=True)], dtype=object)

    fresh = entities(docs, text).withColumn("fresh", made("kind", "mention"))
    return fresh.groupBy("kind", "fresh").agg(F.count("*").alias("n"), F.max(F.col("fresh") == F.col("canon")).alias("same")).where("n > 1 OR same").select("kind", "fresh", "n")


def pseudonymize(docs: DataFrame, text: str = "text", key: bytes = b"vicinal", extra: bool = False) -> DataFrame:
    """Replaces every entity of every text by its surrogate; other columns and rows stay as they are.

    One entity gets one surrogate in all texts and different entities of a
    kind different ones, by permutations alone: there is no table of
    entities, so one pass does it at any size; collisions() audits it.  A
    surrogate may equal another real entity, which is itself replaced
    everywhere.  Persons are found by a title, a listed given name or a cue
    such as "name is".

    Null and empty texts stay, equal rows stay equal, an empty table gives an
    empty one.  With `extra`, columns n_entities and kinds (the kinds found,
    in order, comma-separated) follow and replace input columns of these
    names.
    """
    more = ["n_entities", "kinds"] if extra else []
    keep = [c for c in docs.columns if c not in more]
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[str, str], str] = {}
        for b in small_batches(batches):
            out, count, kinds = [], [], []
            for t in b.column(at).to_pylist():
                found = find(t)
                parts, last = [], 0
                for kind, i, j in found:
                    own = (kind, t[i:j])
                    if own not in made:
                        if len(made) > 100_000:
                            made.clear()
                        made[own] = surrogate(key, *own)
                    parts += [t[last:i], made[own]]
                    last = j
                out.append("".join([*parts, t[last:]]) if found else t)
                count.append(len(found))
                kinds.append(",".join(k for k, _, _ in found))
            cols = list(b.columns)
            cols[at] = pa.array(out, pa.string())
            if extra:
                cols += [pa.array(count, pa.int32()), pa.array(kinds, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *more])

    src = docs.select(*keep)
    wide_ = src.select("*", F.lit(0).alias("n_entities"), F.lit("").alias("kinds")) if extra else src
    return src.mapInArrow(run, wide_.schema)
