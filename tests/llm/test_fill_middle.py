"""Fill-in-the-middle against plain Python; the whole table is in test_oracle_sql."""

import hashlib
import random
import re
from collections import Counter

from harborline.llm import fill_middle as f

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return key, n, "plain", text, None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 80:
        return key, n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m), text
    return key, n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m), text


def check(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, output string, n int")
    made = f.fill_in_middle(df.repartition(partitions)).withColumn("back", f.restored())
    assert Counter(tuple(r) for r in made.collect()) == Counter(plain(*r) for r in rows)


def test_random_texts_with_marks_signs_and_other_planes(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("ab <PSM>\n\t 😀é$\\1\r\x0b\u0085 ", k=rng.randint(0, 40)))) for i in range(4000)]
    check(spark, rows + [(None, " a b c"), (7, None), (8, ""), (5, "twice over"), (5, "twice over")])
    assert f.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_texts_need_no_stack(spark):
    rows = [(i, "w😀 " * 200_000) for i in range(4)] + [(10 + i, " " * 500_000) for i in range(4)]
    check(spark, rows + [(20 + i, "x" * 1_000_000 + "\n") for i in range(4)])


def test_one_narrow_pass_in_the_jvm(spark, sf_small):
    from harborline.llm import queries as q

    plan = q.op12_fill_middle(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Arrow", "Python", "Sort"))
