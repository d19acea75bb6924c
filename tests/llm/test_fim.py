import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fim


def expected(doc_id, text, seed=1, percent=90, spm_percent=20):
    text = text or ""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", text, None, None
    if h[3] % 100 < spm_percent:
        return len(units), "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return len(units), "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


def check(docs, rows, **own):
    made = fim.transform(docs, **own).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars) for r in made), key=str)
    assert got == sorted(((r[0], *expected(r[0], r[1], **own)) for r in rows), key=str)
    assert all(r.again == r.text for r in made)
    assert sorted(r.text for r in made) == sorted(r[1] or "" for r in rows)


@pytest.mark.parametrize("percent", [90, 100])
def test_awkward_documents(frame, awkward, percent):
    rows = [r[:2] for r in awkward] + [(20, "has <P> inside"), (21, "<M>"), (22, "<"), (23, "a<S"), (24, "😀" * 300), (25, "é" * 40 + "abc" * 40), (26, "\n\r\n \t\x00end"), (27, "x")]
    check(frame(rows), rows, percent=percent)


def test_every_count_of_units_around_the_runs(frame):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["word", "x", " ", ".", "é", "😀", "\n", "<", "P>"]) for _ in range(n))) for i, n in enumerate([*range(60, 70), *range(124, 134), 500, 1000, 4097] * 3)]
    check(frame(rows), rows, percent=100, spm_percent=50)


def test_empty_table(frame):
    assert fim.transform(frame([])).count() == 0


def test_one_shuffle(frame, awkward):
    plan = fim.transform(frame(awkward))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan
