"""Operator 5: chat formatting in budgeted, turn-aligned windows with a loss mask.

Prefix sums of turn tokens choose the spans: a conversation's turns are dealt to
spans of equal stride by the tokens before them, and a turn that would run over
its span's end becomes a span of its own. So a window stays within the budget
unless one turn alone is longer, and no turn is cut or dropped. Each window
retains the system turn and repeats a limited history; the loss mask covers the
assistant texts of the span only, so a repeated target is masked.

Template: `<|im_start|>role\\ntext<|im_end|>\\n`. Inside a text every backslash is
doubled and `<|` becomes `<\\|`, which is undone in reverse; a role is URL-encoded.

Defined results: a null text or role is empty; turns of equal number stand in
order of role and text; repeated rows are turns of their own; a null
conversation id is one conversation; an empty table gives an empty table; extra
columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BUDGET = 1024
HISTORY_TURNS = 2
HISTORY_TOKENS = 256
TARGET = "assistant"



def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn as words and punctuation marks, plus four for the template."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long") + 4


def chat_windows(
    turns: DataFrame,
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
    conv: str = "conv_id",
) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text): conv, window, formatted, n_tokens, targets, new_turns.

    `targets` are (start, length) of the text under the loss mask, in code points
    of `formatted`; `new_turns` says how many of the last turns are not repeated.
    """
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tokens", turn_tokens(F.col("text")))
    ordered = Window.partitionBy("conv").orderBy("turn", "role", "text")
    before = F.sum("tokens").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    rows = rows.select(
        "*",
        F.row_number().over(ordered).alias("place"),
        before.alias("before"),
        F.first(F.struct("role", "text", "tokens")).over(ordered).alias("first"),
        *[F.lag(F.struct("role", "text", "tokens"), k).over(ordered).alias(f"back{k}") for k in range(1, history_turns + 1)],
    )
    system = (F.col("first.role") == "system") & (F.col("place") > 1)
    reserved = F.when(F.col("first.role") == "system", F.col("first.tokens")).otherwise(0)
    stride = F.greatest(F.lit(budget) - history_tokens - reserved, F.lit(budget // 4)).cast("long")
    rows = rows.withColumn("span", F.expr("0L") + F.floor(F.col("before") / stride))
    over = F.col("before") + F.col("tokens") > (F.col("span") + 1) * stride
    rows = rows.withColumn("span", F.col("span") * 2 + over.cast("long"))
    opens = F.coalesce(F.lag("span", 1).over(ordered) != F.col("span"), F.lit(True))
    rows = rows.withColumn("lead_in", F.when(opens, _history(system, history_turns, history_tokens)))
    own = F.struct("place", F.lit("new").alias("kind"), "role", "text", "tokens")
    spans = rows.groupBy("conv", "span").agg(
        F.sort_array(F.collect_list(own)).alias("own"), F.max("lead_in").alias("lead_in")
    )
    turn = lambda t: F.struct(t["kind"].alias("kind"), t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens"))
    said = F.concat(F.transform("lead_in", turn), F.transform("own", turn))
    return _formatted(spans.select("conv", "span", said.alias("said")))


def _history(system: Column, turns: int, tokens: int) -> Column:
    """The system turn, then the last turns before a span as far as the history's budget goes."""
    place = lambda k: F.lit(-1 - k).cast("int").alias("place")
    entry = lambda c, k, kind: F.struct(place(k), F.lit(kind).alias("kind"), c["role"].alias("role"), c["text"].alias("text"), c["tokens"].alias("tokens"))
    found = [F.when(system, entry(F.col("first"), turns + 1, "system"))]
    spent = F.lit(0).cast("long")
    for k in range(1, turns + 1):
        back = F.col(f"back{k}")
        spent = spent + F.coalesce(back["tokens"], F.lit(0))
        # the turn that is the system turn itself is not repeated a second time
        fits = back.isNotNull() & (spent <= tokens) & ~(system & (F.col("place") - k == 1))
        found.append(F.when(fits, entry(back, k, "history")))
    return F.sort_array(F.array_compact(F.array(*found)))


def _formatted(spans: DataFrame) -> DataFrame:
    piece = lambda t: F.struct(
        (t["kind"] == "new").alias("new"),
        F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n")).alias("head"),
        escaped(t["text"]).alias("body"),
        ((t["kind"] == "new") & (t["role"] == TARGET)).alias("target"),
    )
    spans = spans.withColumn("pieces", F.transform("said", piece))
    sizes = F.transform("pieces", lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(END) + 1).cast("long"))
    spans = spans.withColumn("sizes", sizes)
    start = lambda i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x)
    place = F.transform("pieces", lambda p, i: F.struct(p["target"].alias("target"), (start(i) + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("long").alias("length")))
    targets = F.transform(F.filter(place, lambda p: p["target"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return spans.select(
        "conv",
        F.col("span").alias("window"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "").alias("formatted"),
        F.aggregate("said", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
        targets.alias("targets"),
        F.size(F.filter("pieces", lambda p: p["new"])).alias("new_turns"),
    )


def parsed_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted window, read back from the template alone."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.url_decode(F.substring_index(body(p), "\n", 1)).alias("role"),
            unescaped(F.substr(body(p), F.length(F.substring_index(body(p), "\n", 1)) + 2)).alias("text"),
        ),
    )


def target_texts(formatted: Column, targets: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(targets, lambda t: unescaped(F.substr(formatted, (t["start"] + 1).cast("int"), t["length"].cast("int"))))


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows say: digests and sizes of the new turns and of the masked text."""
    turns = F.slice("all_turns", F.size("all_turns") - F.col("new_turns") + 1, F.col("new_turns"))
    rows = windows.withColumn("all_turns", parsed_turns(F.col("formatted"))).select(
        "conv",
        F.struct(
            "window",
            F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join(target_texts(F.col("formatted"), F.col("targets")), "").alias("loss"),
        ).alias("part"),
        F.col("new_turns").cast("long").alias("new_turns"),
        F.length("formatted").cast("long").alias("chars"),
    )
    said = rows.groupBy("conv").agg(
        F.sort_array(F.collect_list("part")).alias("parts"),
        F.sum("new_turns").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
    )
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    said = said.withColumn("loss", joined("loss"))
    return said.select(
        "conv",
        "n_turns",
        F.sha2(joined("turns"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
