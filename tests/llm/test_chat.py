import random

from pyspark.sql import functions as F

from meridia.llm import chat

SCHEMA = "tree long, message long, parent long, role string, text string, score double, place int, turns string"


def brute(rows, branches):
    """rows: (tree, message, parent, role, text, score), ids unique and not NULL in their tree."""
    out = []
    for tree in {r[0] for r in rows}:
        mine = {r[1]: r for r in rows if r[0] == tree}
        parents = {r[2] for r in mine.values()}
        paths = []
        for leaf in (m for m in mine if m not in parents):
            path, at = [], leaf
            while at in mine and at not in path:
                path.append(at)
                at = mine[at][2]
            if at not in path:
                paths.append((-sum(mine[m][5] or 0 for m in path), leaf, path[::-1]))
        for branch, (s, leaf, path) in enumerate(sorted(paths)[:branches], 1):
            turns = [(mine[m][3] or "", mine[m][4] or "") for m in path]
            out.append((tree, branch, leaf, -s, turns, "".join(t for r, t in turns if r == "assistant")))
    return sorted(out, key=str)


def read(df):
    rows = chat.read_back(df).collect()
    return sorted(((r.tree, r.branch, r.leaf, r.score, [(t.role, t.text) for t in r.turns], r.loss_text) for r in rows), key=str)


def test_trees_against_brute_force(spark):
    rnd = random.Random(8)
    bits = ["</s>", "[INST]", "[/INST] ", "<<SYS>>", "<s>", "\\", "<", "\\<", "é\U0001f600", "\n", "x y", "<<TEXT>>", "<</TEXT>>", "<<ROLE>>", "$1", "[", "<<s>>"]
    text = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 8)))
    rows = []
    for tree in [None, *range(25)]:
        n = rnd.randrange(1, 30)
        for m in range(n):
            parent = None if m == 0 else rnd.choice([m - 1, rnd.randrange(m), 1000])
            rows.append((tree, m, parent, rnd.choice(["user", "assistant", "system", "tool <s>", "", None]), rnd.choice([text(), text(), None]), rnd.choice([0.5, 1.0, -2.0, None])))
    rows += [(50, i, i - 1 if i else None, "user" if i % 2 else "assistant", text(), 1.0) for i in range(300)]  # a long chain
    rows += [(51, 1, 2, "user", "round", 1.0), (51, 2, 1, "user", "and round", 1.0), (51, 3, 2, "user", "below", 1.0), (51, 4, None, "user", "root", 0.0)]
    rows += [(52, i, 0, "user", str(i), 0.0) for i in range(1, 400)] + [(52, 0, None, "system", "star", 0.0)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA).repartition(4)
    for branches in (1, 3):
        assert read(chat.format_paths(df, branches)) == brute(rows, branches)
    made = chat.format_paths(df.union(df), 1)  # repeated messages are one message
    assert read(made) == brute(rows, 1)
    for r in made.collect():
        whole = r.formatted.encode()
        assert all(whole[s.start - 3:s.start] == b"<s>" and whole[s.start + s.length:].startswith(b"</s>") for s in r.loss)
    assert chat.format_paths(df.limit(0)).count() == 0


def test_odd_messages(spark):
    rows = [(1, None, 7, "assistant", "no id", 2.0), (1, 7, None, "user", "q", float("nan")), (1, 8, 7, "assistant", "a" * 200000, 1.0)]
    got = read(chat.format_paths(spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA), 5))
    assert [(g[1], g[2], g[3], [t[1][:5] for t in g[4]]) for g in got] == [(1, None, 2.0, ["q", "no id"]), (2, 8, 1.0, ["q", "aaaaa"])]


def test_escape_round_trip(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("<>[]/\\sINTSYROLEX") for _ in range(rnd.randrange(40))) for _ in range(3000)]
    texts += [a + b for a in chat.CONTROL for b in [*chat.CONTROL, "\\", "<"]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROL)


def test_plain_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, None, "system", None), (None, 3, None, "x"), (None, 3, "user", "y"), (2, 0, "assistant", "</s>")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, message int")
    got = read(chat.format_paths(chat.as_messages(df)))
    assert [(g[0], g[4], g[5]) for g in got] == [
        (1, [("system", ""), ("user", "a"), ("assistant", "b"), ("assistant", "b")], "bb"),
        (2, [("assistant", "</s>")], "</s>"), (None, [("", "x"), ("user", "y")], "")]


def test_native_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    made = chat.read_back(chat.format_paths(chat.as_messages(df)))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
