from hashlib import sha256

import pytest

from tidemark.llm import naming


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        own = groups[t or ""]
        known = [x for x in own if x is not None]
        out.append((i, max(known) if known else None, len(own), sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [16384, 7, 1000])
def test_groups_are_equal_texts(frame, awkward, block):
    rows = [r[:2] for r in awkward] + [(50, "abcdefgabcdefg" * 9), (51, "abcdefgabcdefg" * 9), (52, "abcdefgabcdefg" * 10), (53, "abcdefg")]
    got = naming.exact_groups(frame(rows), block_bytes=block).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected(rows)
    assert sum(r.kept for r in got) == len({t or "" for _, t in rows})  # one row of each text, also of repeated rows


def test_blocks_with_one_digest_are_noticed(frame):
    rows = [(1, "aaaa"), (2, "bbbb")]
    with pytest.raises(ValueError, match="digest"):
        naming.identities(frame(rows), digest="unhex('00')" + " || substring({block}, 1, 0)")


def test_empty_table_and_kept_rows(frame, awkward):
    assert naming.exact_groups(frame([])).count() == 0
    docs = frame(awkward)
    kept = naming.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.text or "") for r in kept.collect()) == sorted({r[1] or "" for r in awkward})
