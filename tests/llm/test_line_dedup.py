import random

from meridia.llm.line_dedup import dedup_lines

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars, min_docs):
    """rows: (doc_id, text); NULL id smallest."""
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add((d is not None, d or 0))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == (d is not None, d or 0)]
        out.append((d is not None, d or 0, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def test_against_brute_force(spark):
    rnd = random.Random(4)
    common = ["Licensed under the Something License", "  all RIGHTS reserved, by nobody \t", "éééééééééééééééééééé", "short", "Ünïcode ÀÉ line of twenty"]
    rows = []
    for i in range(80):
        lines = [rnd.choice(common) if rnd.random() < 0.5 else f"line {rnd.randrange(40)} of some document" for _ in range(rnd.randrange(0, 9))]
        rows.append((i, rnd.choice(["\n", "\n\n", "\r\n"]).join(lines)))
    rows += [(None, common[0]), (None, None), (200, None), (201, ""), (202, "\n\n"), (7, rows[7][1]), (8, common[1].upper()), (203, (common[0] + "\n") * 5000)]
    df = spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id long, text string, row string, drops int")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in dedup_lines(df).collect())
    assert got == brute(rows, 20, 3)
    assert dedup_lines(df.limit(0)).count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = dedup_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
