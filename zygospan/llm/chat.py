"""Chat formatting of reply trees.

Iterative self-joins double the reach of every message's parent link, then spell out the paths from each leaf to its
root. Branches are ranked by score, and each chosen path is written as one conversation with a loss mask.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zygospan.llm.common import column, cut, release

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]")
CONTROL = [m for pair in (*MARKS.values(), OTHER) for m in pair]
_TO_ESCAPE = re.compile("|".join(re.escape(c) for c in ("\\", *CONTROL)))
_MARK = re.compile(r"\\.|" + "|".join(re.escape(c) for c in CONTROL), re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_ROLE = re.compile(r"((?:[^\\\n]|\\.)*)\n(.*)", re.S)


def escape(text: str) -> str:
    """A backslash before every backslash and control string."""
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of it, in code points, that bear loss: the assistant's words."""
    out, spans, at = [], [], 0
    for role, text in turns:
        opens, closes = MARKS.get(role, OTHER)
        # A line feed ends the role, so one within it is escaped too.
        named = escape(role).replace("\n", "\\\n")
        head = opens if role in MARKS else f"{opens}{named}\n"
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, closes)
        at += len(head) + len(body) + len(closes)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    roles = {a: r for r, (a, _) in MARKS.items()}
    turns, role, start = [], None, 0
    for m in _MARK.finditer(formatted):
        if m[0][0] == "\\":
            continue
        if m[0] in roles or m[0] == OTHER[0]:
            role, start = roles.get(m[0]), m.end()
        else:
            body = formatted[start : m.start()]
            if role is None:
                name, body = _ROLE.fullmatch(body).groups()
                role = unescape(name)
            turns.append((role, unescape(body)))
    return turns


def from_turns(rows: DataFrame) -> DataFrame:
    """Messages of plain conversations: ``conv_id, key, node, parent, role, text, score``, each a reply to the one before.

    Rows lie by turn, ties by role and text, null turns first. A conversation is laid out in one task, as it leaves in
    one row.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select(F.col("conv_id").cast("long"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """``key, leaf, node, up`` for every message on the way from each leaf to its root, ``up`` steps above the leaf.

    A parent that is missing ends the path as a root does. Raises an error on a cycle.
    """
    spark = messages.sparkSession
    most = messages.count()
    links = messages.select("key", "node", F.col("parent").alias("up"))
    known = links.select("key", F.col("node").alias("up"))
    jumps = [cut(links.join(known, ["key", "up"], "left_semi").select("key", "node", "up"), "reply_links")]
    while not jumps[-1].isEmpty():
        if 1 << len(jumps) > 2 * most:
            raise ValueError("the parent links hold a cycle")
        a, b = jumps[-1], jumps[-1].select("key", F.col("node").alias("up"), F.col("up").alias("far"))
        jumps.append(cut(a.join(b, ["key", "up"]).select("key", "node", F.col("far").alias("up")), "reply_links"))
        release(spark)
    out = cut(messages.select("key", "node").join(jumps[0].select("key", F.col("up").alias("node")).distinct(), ["key", "node"], "left_anti"), "reply_leaves")
    out = out.select("key", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in range(len(jumps) - 2, -1, -1):
        step = jumps[k].select("key", "node", F.col("up").alias("to"))
        more = out.join(step, ["key", "node"]).select("key", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        out = cut(out.unionByName(more), "reply_paths")
    return out


def format_conversations(messages: DataFrame, best: int | None = None) -> DataFrame:
    """``conv_id, leaf, score, branch, formatted, loss_spans, n_turns`` per chosen path of each reply tree.

    ``messages`` has ``conv_id, node, parent, role, text, score``; nodes are unique in a conversation. A path's score
    is its messages' sum (null counts 0); ``branch`` ranks the paths of a conversation by falling score, then by leaf,
    and ``best`` keeps that many. Null texts and roles are empty; a null conv_id is a conversation of its own. Role
    and text go through an escape that ``parse`` undoes. No rows give none.
    """
    messages = messages.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    messages = cut(messages.select("key", "conv_id", "node", "parent", "role", "text", "score"), "messages")
    on_path = paths(messages).join(messages.drop("parent"), ["key", "node"])
    turn = F.struct((-F.col("up")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = on_path.groupBy("key", "leaf").agg(
        F.first("conv_id").alias("conv_id"), F.sum(F.coalesce("score", F.lit(0.0))).alias("score"), F.array_sort(F.collect_list(turn)).alias("turns")
    )
    # Ranked from narrow rows; ``best`` only filters.
    rank = Window.partitionBy("key").orderBy(F.desc("score"), "leaf")
    scores = on_path.groupBy("key", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
    names = scores.select("key", "leaf", F.row_number().over(rank).alias("branch"))
    whole = whole.join(names if best is None else names.filter(F.col("branch") <= best), ["key", "leaf"])

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            texts, spans, n = [], [], []
            for turns in column(batch, "turns"):
                t, s = render([(x["role"], x["text"]) for x in turns])
                texts.append(t)
                spans.append([{"start": a, "stop": b} for a, b in s])
                n.append(len(turns))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(texts, pa.string()), pa.array(spans, kind), pa.array(n, pa.int64())],
                ["conv_id", "leaf", "score", "branch", "formatted", "loss_spans", "n_turns"],
            )

    return whole.select("conv_id", "leaf", "score", "branch", "turns").mapInArrow(
        run, "conv_id long, leaf long, score double, branch int, formatted string, loss_spans array<struct<start:long,stop:long>>, n_turns long"
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from the formatted text alone: turns, and the words under the loss mask."""
    def run(batches):
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(column(batch, c) for c in ("conv_id", "formatted", "loss_spans"))):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((conv, len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)
