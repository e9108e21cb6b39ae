"""Chat formatting: reply trees to conversations, DataFrame functions throughout.

Messages name their parent inside their tree.  Pointers to ancestors are doubled by
self-joins of ids alone, so a path of d messages takes log2(d) rounds; the rounds give
every message its depth and the summed score of its path from the root.  Leaves are
ranked by that score within their tree; only the chosen paths are expanded, by the same
stored pointers from the longest to the shortest, and only they meet their texts.

Each turn is written between marks of its role.  Inside a text a backslash is doubled and
every control string gets one after its first character, so that no control string is
left and reading is one replacement.  The loss mask are the bytes of the assistants'
texts in the formatted UTF-8.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.common import Stages

#: Marks before and after the text of a turn, by role; other roles are spelled out between ROLE marks.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE, TEXT, END = "<<ROLE>>", "<<TEXT>>", "<</TEXT>>"
TRAINED = "assistant"

CONTROL = [m.strip() for pair in MARKS.values() for m in pair] + [ROLE, TEXT, END]
#: The first character of a control string, seen from there.
_OPENS = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)
_TURN = "(?s)" + "|".join(f"{re.escape(a)}.*?{re.escape(b)}" for a, b in [*MARKS.values(), (ROLE, END)])


def escape(text: Column) -> Column:
    """The text without control strings; :func:`unescape` gives it back."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_OPENS})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def as_messages(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of plain conversations: each turn answers the one before it.

    Turns of one number, NULL (first) included, follow each other by role and text, so
    repeated rows are turns of their own; rows of a NULL conversation are one conversation.
    """
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.select(
        turns[conv_col].alias("tree"), turns[turn_col].alias("turn"), F.coalesce(turns[role_col], F.lit("")).alias("role"),
        F.coalesce(turns[text_col], F.lit("")).alias("text"))
    at = F.row_number().over(order).cast("bigint")
    return rows.select("tree", at.alias("message"), F.when(at > 1, at - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _same(a: str, b: str, left: str, right: str) -> Column:
    """Rows of one tree, NULL being a tree, with ``left`` of one side equal to ``right`` of the other."""
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & (F.col(f"{a}.{left}") == F.col(f"{b}.{right}"))


def _same_message(a: str, b: str) -> Column:
    """One message on both sides, NULL being a tree and an id."""
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & F.col(f"{a}.message").eqNullSafe(F.col(f"{b}.message"))


def _doubled(stages: Stages, messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointers of the messages, and those whose path to the root is known.

    Table k has the messages that lie at least 2**k below their root, pointing that far up
    (``up``).  The second frame gives tree, message, depth and gain, the score of the path;
    messages under a loop of parents are in every table and have no path.  A round joins
    only the messages whose root is not reached yet.
    """
    present = messages.select("tree", F.col("message").alias("known")).alias("p")
    own = stages.keep(messages.alias("m").join(present, _same("m", "p", "parent", "known"), "left").select(
        "m.tree", "m.message", F.col("p.known").alias("up"), F.col("p.known").isNotNull().cast("bigint").alias("depth"),
        F.col("m.score").alias("gain")), "up")
    up, rooted = [own.where("up IS NOT NULL")], own.where("up IS NULL").drop("up")
    open_ends = up[-1].count()
    while open_ends:
        a, b = up[-1].alias("a"), up[-1].unionByName(rooted, allowMissingColumns=True).alias("b")
        further = stages.keep(a.join(b, _same("a", "b", "up", "message")).select(
            "a.tree", "a.message", F.col("b.up").alias("up"), (F.col("a.depth") + F.col("b.depth")).alias("depth"),
            (F.col("a.gain") + F.col("b.gain")).alias("gain")), "up")
        up.append(further.where("up IS NOT NULL"))
        rooted = rooted.unionByName(further.where("up IS NULL").drop("up"))
        left = up[-1].count()
        if left == open_ends:  # a round ends some path, so what is left goes round in loops
            break
        open_ends = left
    return up, rooted


def best_paths(messages: DataFrame, branches: int, stages: Stages) -> DataFrame:
    """tree, branch, leaf, score, message, place: the messages of each tree's best root-to-leaf paths."""
    up, rooted = _doubled(stages, messages)
    ends = rooted.alias("e")
    parents = messages.where("parent IS NOT NULL").select("tree", "parent").distinct().alias("q")
    leaves = ends.join(parents, _same("e", "q", "message", "parent"), "left_anti")
    # messages without an id have no replies; the order ends with them
    rank = Window.partitionBy("tree").orderBy(F.desc("gain"), F.col("message").asc_nulls_last())
    chosen = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    paths = stages.keep(chosen.select(
        "tree", "branch", F.col("message").alias("leaf"), F.col("gain").alias("score"), "message", F.col("depth").alias("place")), "paths")
    for k in reversed(range(len(up))):  # each message stays and, if it points that far, brings the one it points to
        a, b = paths.alias("a"), up[k].alias("b")
        here, above = F.struct("a.message", "a.place"), F.struct(F.col("b.up").alias("message"), (F.col("a.place") - F.lit(1 << k)).alias("place"))
        both = F.when(F.col("b.up").isNull(), F.array(here)).otherwise(F.array(here, above))
        paths = a.join(b, _same_message("a", "b"), "left").select("a.tree", "a.branch", "a.leaf", "a.score", F.inline(both))
    return paths


def format_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, branch, leaf, score, formatted, loss: one conversation per chosen path.

    ``messages`` has tree, message, parent, role, text and score; other columns are
    ignored.  The ``branches`` best paths of each tree by summed score, ties to the
    smaller leaf id, become conversations; ``branch`` counts from 1.  ``loss`` lists
    (start, length) in bytes of the formatted UTF-8: each assistant text once, in order.

    A parent that is not in the tree is no parent, as NULL.  Rows sharing an id are one
    message, the smallest by parent, role, text and score; one without an id cannot be
    replied to.  NULL trees are one tree; NULL roles and texts count as empty, NULL and
    NaN scores as 0.  Messages below a loop of parents have no root and take no part.
    Texts of any length stay whole; a conversation is one row, as its reader needs it.
    An empty table gives no rows.
    """
    stages = Stages(messages.sparkSession)
    score = F.col("score").cast("double")
    rows = messages.select(
        "tree", "message", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.isnan(score) | score.isNull(), 0.0).otherwise(score).alias("score"))
    named = rows.groupBy("tree", "message").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
    told = stages.keep(named.select("tree", "message", "m.*"), "messages")
    paths = best_paths(told, branches, stages)
    turns = paths.alias("a").join(told.alias("b"), _same_message("a", "b"))
    opens, closes = F.concat(F.lit(ROLE), escape(F.col("b.role")), F.lit(TEXT)), F.lit(END)
    for role, (a, b) in MARKS.items():
        opens, closes = (F.when(F.col("b.role") == role, F.lit(x)).otherwise(y) for x, y in ((a, opens), (b, closes)))
    spelled = turns.select(
        "a.tree", "branch", "leaf", "a.score", "place", opens.alias("opens"), escape(F.col("b.text")).alias("body"), closes.alias("closes"),
        (F.col("b.role") == TRAINED).alias("trained"))
    size = F.octet_length("opens") + F.octet_length("body") + F.octet_length("closes")
    before = Window.partitionBy("tree", "branch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.octet_length("opens")
    placed = spelled.select(
        "tree", "branch", "leaf", "score", "place", F.concat("opens", "body", "closes").alias("piece"),
        F.when(F.col("trained"), F.struct(start.alias("start"), F.octet_length("body").cast("bigint").alias("length"))).alias("span"))
    whole = placed.groupBy("tree", "branch").agg(
        F.first("leaf").alias("leaf"), F.first("score").alias("score"),
        F.array_sort(F.collect_list(F.struct("place", "piece", "span"))).alias("turns"))
    return whole.select(
        "tree", F.col("branch").cast("int").alias("branch"), "leaf", "score", F.array_join("turns.piece", "").alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with turns (role, text) and loss_text, both read from ``formatted`` and ``loss`` alone.

    Read from a stored table, so that no text is formatted once more for each of its spans.
    """

    def turn(piece: Column) -> Column:
        found = F.struct(
            unescape(F.regexp_extract(piece, f"(?s)^{ROLE}(.*?){TEXT}", 1)).alias("role"),
            unescape(F.regexp_extract(piece, f"(?s)^{ROLE}.*?{TEXT}(.*){END}$", 1)).alias("text"))
        for role, (a, b) in MARKS.items():
            inside = F.substr(piece, F.lit(len(a) + 1), F.char_length(piece) - len(a) - len(b))
            found = F.when(F.startswith(piece, F.lit(a)), F.struct(F.lit(role).alias("role"), unescape(inside).alias("text"))).otherwise(found)
        return found

    # the array of one holds the bytes once for all spans
    spans = F.transform(F.array(F.col("formatted").cast("binary")), lambda whole: F.transform(
        "loss", lambda s: unescape(F.substr(whole, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))))
    return chats.select(
        "*", F.transform(F.regexp_extract_all("formatted", F.lit(_TURN), 0), turn).alias("turns"),
        F.array_join(F.get(spans, F.lit(0)), "").alias("loss_text"))
