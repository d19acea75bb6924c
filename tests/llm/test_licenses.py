import random
import re

import pytest

from tidemark.llm import licenses

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    starts, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        own = phrase.encode().split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)


def test_base_equals_brute_force(spark, sf, frame, awkward):
    rows = [*awkward, (30, "MIT license, mit-LICENSE; mitlicense MIT\nLicense"), (31, "general general public license public license"), (32, "éMIT License MIT Licenseé"), (33, "Apache License general public license")]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for docs, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (frame(rows), [r[:2] for r in rows]), (frame([]), [])):
        got = licenses.scan(docs).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
        assert all(set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize(
    ("expression", "labels"),
    [
        ("MIT", {"mit"}),
        ("MIT OR GPL-2.0", {"mit"}),
        ("MIT AND GPL-2.0", {"mit", "gpl"}),
        ("GPL-2.0 OR Apache-2.0 AND GPL-2.0-only", {"gpl"}),  # as restrictive, fewer labels
        ("(GPL-3.0 OR Apache-2.0) AND BSD-3-Clause", {"apache", "bsd"}),
        ("GPL-2.0+ WITH Classpath-exception-2.0 OR GPL-2.0", {"gpl"}),
        ("GPL-2.0+ WITH Classpath-exception-2.0 OR AGPL-3.0", {"gpl"}),
        ("AGPL-3.0 WITH some-exception OR GPL-3.0", {"agpl"}),  # softened below plain copyleft
        ("LGPL-3.0 AND (MIT)", {"lgpl", "mit"}),
        ("CC-BY-NC-4.0", {"cc-by-nc"}),
        ("Custom-1.0", {"unknown"}),
        ("Custom-1.0 OR AGPL-3.0", {"unknown"}),  # what is not known is no reason to take copyleft
        ("Custom-1.0 OR LGPL-3.0", {"unknown"}),
        ("Custom-1.0 OR MIT", {"mit"}),
        ("Zlib OR GPL-2.0", {"zlib"}),
        ("Artistic-2.0 OR AGPL-3.0", {"artistic"}),
        ("LicenseRef-own AND MIT", {"mit", "unknown"}),
        ("CC0-1.0 OR MIT", {"public-domain"}),
        ("MIT-0", {"mit-0"}),
        ("BSD-2-Clause OR Apache-2.0", {"apache"}),  # alike: the first in the alphabet
    ],
)
def test_expressions(expression, labels):
    assert licenses.evaluate(expression) == labels


def ways(expression):
    """All ways to meet an expression of identifiers, ``and``, ``or``, and their labels, by brute force."""
    stack = []
    for token in licenses.postfix(expression):
        if token in ("and", "or"):
            right, left = stack.pop(), stack.pop()
            stack.append(left + right if token == "or" else [a | b for a in left for b in right])
        else:
            stack.append([frozenset([licenses.label_of(token)])])
    return stack[0]


def test_the_mildest_way_is_taken():
    rng = random.Random(1)
    names = ["MIT", "GPL-2.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-NC-4.0", "Own-1"]

    def some(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice(names)
        return f"({some(depth - 1)} {rng.choice(['AND', 'OR'])} {some(depth - 1)})"

    rank = lambda labels: max(licenses.RESTRICTIVE[x] for x in labels)
    for _ in range(300):
        expression = some(4)
        found, every = licenses.evaluate(expression), ways(expression)
        assert found in every
        assert rank(found) == min(map(rank, every))


@pytest.mark.parametrize("bad", ["see the file", "SEE LICENSE IN license.md", "MIT OR whatever", "", "OR MIT", "MIT AND", "(MIT", "MIT)", "()", "MIT OR OR BSD"])
def test_malformed_expressions(bad):
    with pytest.raises(ValueError):
        licenses.evaluate(bad)


def test_no_expression_is_too_long():
    expression = " AND ".join(f"(a{i} OR MIT OR b{i})" for i in range(5000))  # 3^5000 ways
    assert licenses.evaluate(expression) == {"mit"}


def test_tags_and_notices():
    scan = licenses.Scanner(licenses.BASE_PHRASES, licenses.NOTICE_PHRASES).scan
    assert scan(b"# SPDX-License-Identifier: MIT OR GPL-2.0\ncode")[5:7] == ({"mit"}, 1.0)
    assert scan(b"# SPDX-License-Identifier: MIT AND GPL-2.0\ncode")[5:7] == ({"mit", "gpl"}, 1.0)
    assert scan(b"SPDX-License-Identifier: MIT\nxspdx-license-identifier: foo\nspdx-license-identifiers: bar\n")[5] == {"mit"}
    assert scan(b"SPDX-License-Identifier: AND AND\n")[5:7] == (set(), 0.5)
    assert scan(b"SPDX-License-Identifier: see the file\n")[5:7] == (set(), 0.5)
    assert scan(b"Licensed under CC BY-NC 4.0.")[5] == {"cc-by-nc"}
    assert scan(b"GNU Lesser General Public License")[4:6] == ({"gpl"}, {"gpl", "lgpl"})
