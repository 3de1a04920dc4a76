"""Chat formatting in budgeted, turn-aligned windows with a loss mask.

Everything here is DataFrame and SQL functions; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What counts as one token of a turn's budget: a run of letters, up to three digits, or a run of other marks.
TOKEN = r"[\p{L}\p{M}]+|\p{N}{1,3}|[^\s\p{L}\p{M}\p{N}]+"
#: Tokens of a turn's marks and role.
TURN_COST = 5


def escape(col: Column) -> Column:
    """Puts one more backslash inside every `<|`, `<\\|`, `<\\\\|` and so on, so that no control string is left."""
    return F.regexp_replace(col, r"<(\\*)\|", r"<\\$1|")


def unescape(col: Column) -> Column:
    """Takes that backslash out again."""
    return F.regexp_replace(col, r"<\\(\\*)\|", r"<$1|")


def escape_role(col: Column) -> Column:
    """A role in one line: backslash as \\b, line feed as \\n, then escape()."""
    return escape(F.replace(F.replace(col, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(col: Column) -> Column:
    return F.replace(F.replace(unescape(col), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def once(col: Column, name: str) -> Column:
    """The value as a generated column, so that the optimizer can't copy its expression into later lambdas."""
    return F.explode(F.array(col)).alias(name)


def format_windows(turns: DataFrame, budget: int = 2048, history_tokens: int = 256, history_turns: int = 4, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formats every conversation in windows of `budget` tokens at most.

    Prefix sums of the turns' tokens choose spans of whole turns: a span
    closes where the next turn would pass the budget.  A leading system turn
    is kept at the front of every window; each later window then repeats up
    to `history_turns` turns before its span, of `history_tokens` tokens in
    all and of what the budget leaves.  Only assistant turns of the span
    itself are targets; repeated ones are masked, so each target is learned
    once.  A turn that with the system turn passes the budget gets a window
    of its own, whole and without history; only such windows pass it.

    Returns (conv_id, window, formatted, n_repeated, loss_spans, n_tokens):
    loss_spans are (start, end) in code points of `formatted`, n_repeated
    counts the leading turns that an earlier window already had.

    Turns are ordered by turn, role, text, nulls first; null roles and texts
    are empty; equal rows are all kept; a null conv_id is one conversation;
    other columns are ignored; an empty table gives an empty one.  Texts of any
    length stay whole.  A conversation is one record, put together in one
    task.
    """
    base = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("n", F.regexp_count("text", F.lit(TOKEN)) + TURN_COST)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    sums = base.withColumn("cum", F.sum("n").over(order))
    convs = sums.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "cum", "n"))).alias("turns"))
    lead = F.expr("if(turns[0].role = 'system', 1, 0)")
    parts = convs.select("conv_id", "turns", once(lead, "lead"))
    parts = parts.select("conv_id", F.expr("slice(turns, 1, lead)").alias("head"), F.expr("slice(turns, lead + 1, greatest(0, size(turns) - lead))").alias("body"))
    parts = parts.select("conv_id", once(F.struct("head", "body"), "c")).select("conv_id", "c.head", "c.body").withColumn("head_n", F.expr("coalesce(get(head, 0).n, 0)"))
    # boundaries: (starts, tokens before the span, turns seen, tokens seen)
    starts = F.expr(
        f"""aggregate(body,
              struct(array(1) AS starts, cast(head_n AS bigint) AS base, 0 AS seen, cast(head_n AS bigint) AS last),
              (a, t) -> if(
                t.cum - a.base > {budget} - head_n - if(size(a.starts) = 1, 0, {history_tokens}) AND a.seen + 1 > element_at(a.starts, -1),
                struct(concat(a.starts, array(a.seen + 1)) AS starts, a.last AS base, a.seen + 1 AS seen, t.cum AS last),
                struct(a.starts AS starts, a.base AS base, a.seen + 1 AS seen, t.cum AS last)),
              a -> a.starts)"""
    )
    cut = parts.select("conv_id", "head", "head_n", "body", once(starts, "starts"))
    windows = F.expr(
        f"""transform(starts, (s, w) -> struct(
              w AS window,
              concat(
                if(w > 0, head, slice(head, 1, 0)),
                filter(slice(body, greatest(1, s - {history_turns}), least({history_turns}, s - 1)),
                       t -> body[greatest(0, s - 2)].cum - t.cum + t.n <= least({history_tokens},
                         {budget} - head_n - (body[coalesce(get(starts, w + 1), size(body) + 1) - 2].cum - body[greatest(0, s - 2)].cum)))) AS old,
              concat(
                if(w = 0, head, slice(head, 1, 0)),
                slice(body, s, coalesce(get(starts, w + 1), size(body) + 1) - s)) AS new))"""
    )
    rows = cut.select("conv_id", F.explode(windows).alias("w")).select("conv_id", "w.window", "w.old", "w.new")
    both = rows.select("conv_id", "window", F.size("old").alias("n_repeated"), once(F.concat("old", "new"), "turns"))

    def piece(t: Column) -> Column:
        front = F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
        body = escape(t["text"])
        return F.struct(front.alias("front"), body.alias("body"), (t["role"] == "assistant").alias("target"), t["n"].alias("n"))

    made = both.select("conv_id", "window", "n_repeated", once(F.transform("turns", piece), "pieces"))
    tail = END + "\n"
    spans = F.expr(
        f"""filter(transform(pieces, (p, i) -> struct(
              p.target AND i >= n_repeated AS target,
              aggregate(slice(pieces, 1, i), length(p.front), (a, q) -> a + length(q.front) + length(q.body) + {len(tail)}) AS start,
              length(p.body) AS len)), x -> x.target)"""
    )
    return made.select(
        "conv_id", "window",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["front"], p["body"], F.lit(tail))), "").alias("formatted"),
        "n_repeated",
        F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["len"]).alias("end"))).alias("loss_spans"),
        F.expr("aggregate(pieces, 0L, (a, p) -> a + p.n)").alias("n_tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Parses formatted windows: (conv_id, window, turns, targets, chars).

    turns are the (role, text) an earlier window has not had, targets the
    unescaped texts under the loss mask, chars the length of the window.
    """
    cut = F.expr(f"slice(split(formatted, '{START.replace('|', '[|]')}'), 2 + n_repeated, 1000000000)")
    parsed = windows.select("conv_id", "window", "formatted", "loss_spans", once(cut, "parts"))
    line = lambda p: F.substring_index(p, "\n", 1)
    return parsed.select(
        "conv_id", "window",
        F.transform("parts", lambda p: F.struct(
            unescape_role(line(p)).alias("role"),
            unescape(F.substring(p, F.length(line(p)) + 2, F.length(p) - F.length(line(p)) - (2 + len(END)))).alias("text"),
        )).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))).alias("targets"),
        F.length("formatted").alias("chars"),
    )


def digests(windows: DataFrame) -> DataFrame:
    """One row for each conversation, from its formatted windows alone.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows)
    """
    back = read_back(windows).select(
        "conv_id", "window", F.size("turns").alias("n"), "chars",
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("loss"),
    )
    whole = back.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum(F.length("loss")).alias("loss_chars"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"),
        F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("parts"),
    )
    join = lambda field: F.array_join(F.transform("parts", lambda p: p[field]), "")
    return whole.select("conv_id", "n_turns", F.sha2(join("said"), 256).alias("turns_sha256"), "loss_chars", F.sha2(join("loss"), 256).alias("loss_sha256"), "formatted_chars", "n_windows")
