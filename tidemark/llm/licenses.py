"""License scan: notice phrases and identifier tags.

Aho-Corasick finds, in one pass over a text's words, the notice phrases and the places of
identifier tags.  The expression after a tag is parsed with a shunting yard and evaluated: ``or``
leaves a choice, of which the less restrictive side is taken, ``and`` binds to both sides,
``with`` softens a copyleft licence by an exception.  The labels of what the evaluation comes
to are the text's, so ``MIT OR GPL-2.0`` gives mit and ``MIT AND GPL-2.0`` gives both.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that state a licence, and its label.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Further notice phrases of the method, and labels.
NOTICE_PHRASES = {
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by": "cc-by",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}

#: Words of an identifier tag, as words of the text.
TAG = "spdx license identifier"

#: How restrictive a label is, from 0: free of conditions, notice only, unknown, conditions on changed files,
#: on whole works, on use over a network, on purpose or change, no licence at all.  What is not known is never
#: a reason to take a copyleft side, nor to leave a side that is known to ask for a notice only.
FREE, NOTICE, UNKNOWN, FILES, WORKS, NETWORK, LIMITED, CLOSED = range(8)

#: Families of licence identifiers (what comes before a version or variant), by how restrictive they are.
FAMILIES = {
    FREE: "0bsd blessing cc0 cc-pddc fsfap fsfullr libselinux mit-0 pddl public-domain sax-pd unlicense wtfpl",
    NOTICE: "adsl afl amdplpa aml apache apafml artistic bitstream-vera blueoak boehm-gc borceux bsd bsl bzip2 caldera cc-by cecill-b cnri cube curl diffmark dotseqn dsdp egenix entessa eudatagrid fsful ftl giftware glide hpnd "
    "ibm-pibs icu ijg imagemagick info-zip intel isc jasper json latex2e libpng libtiff mirros mit mit-cmu mitnfa mpich2 mtll mulanpsl naumen ncsa net-snmp netcdf newsletr nist ntp odc-by ofl ogl oldap olfl openssl php plexus postgresql psf "
    "psfrag psutils python rsa-md ruby saxpath sgi-b smlnj ssh-openssh tcl tcp-wrappers tmate torque ucar unicode upl vim vsl w3c x11 xerox xinetd xnet xpp zed zend zlib zpl",
    FILES: "apsl cddl cecill-c cpl ecl ecos epl erlpl frameworx ipl lgpl lgpllr lpl mpl ms-pl ms-rl nasa nokia nosl npl rpsl simpl spl sissl ypl zimbra",
    WORKS: "cc-by-sa cecill copyleft-next eupl gfdl gpl lal odbl ms-lpl osl qpl rpl sleepycat watcom",
    NETWORK: "agpl cpal sspl parity",
    LIMITED: "aladdin busl cc-by-nc cc-by-nc-nd cc-by-nc-sa cc-by-nd elastic hippocratic polyform prosperity",
    CLOSED: "none noassertion proprietary",
}
RANK_OF_FAMILY = {family: rank for rank, families in FAMILIES.items() for family in families.split()}

#: Labels that stand for several families.
SAME_LABEL = {"0bsd": "bsd", "cc0": "public-domain", "cc-pddc": "public-domain", "unlicense": "public-domain", "none": "proprietary", "noassertion": "unknown"}
RESTRICTIVE = {SAME_LABEL.get(f, f): rank for f, rank in RANK_OF_FAMILY.items()} | {"public-domain": FREE, "bsd": NOTICE, "unknown": UNKNOWN}
SOFTENED = {WORKS: FILES, NETWORK: FILES}  # an exception makes strong copyleft weak
IDENTIFIER = re.compile(r"licenseref-|documentref-|.*[0-9-]")  # what an identifier that is not known looks like; other words are prose

BINDING = {"or": 1, "and": 2, "with": 3}
TAG_IN_TEXT = re.compile(rb"(?<![0-9a-z\x80-\xff])spdx[^0-9a-z\x80-\xff]+license[^0-9a-z\x80-\xff]+identifier(?![0-9a-z\x80-\xff])[ \t]*:?[ \t]*([^\r\n]*)")
TOKEN = re.compile(r"[()]|[0-9A-Za-z.+:-]+")
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def postfix(expression: str) -> list[str]:
    """The tokens of a licence expression in postfix order, by a shunting yard.  ValueError if it is malformed."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in TOKEN.findall(expression.lower()):
        if token in BINDING:
            if operand_next:
                raise ValueError(f"no operand before {token}")
            while held and held[-1] != "(" and BINDING[held[-1]] >= BINDING[token]:
                out.append(held.pop())
            held.append(token)
            operand_next = True
        elif token == "(":
            if not operand_next:
                raise ValueError("no operator before (")
            held.append(token)
        elif token == ")":
            if operand_next:
                raise ValueError("no operand before )")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError("no ( for )")
            held.pop()
        else:
            if not operand_next:
                break  # the expression has ended; prose goes on
            out.append(token)
            operand_next = False
    if operand_next or "(" in held:
        raise ValueError("the expression is incomplete")
    return out + held[::-1]


def label_of(identifier: str) -> str:
    """The label of a licence identifier: that of the longest family it belongs to, ``unknown`` without one.  ValueError if it is a word of prose."""
    parts = re.split("(?=[-+])", identifier.removesuffix("+"))
    for n in range(len(parts), 0, -1):
        if (family := "".join(parts[:n])) in RANK_OF_FAMILY:
            return SAME_LABEL.get(family, family)
    if not IDENTIFIER.match(identifier):
        raise ValueError(f"{identifier} is no identifier")
    return "unknown"


def evaluate(expression: str) -> frozenset[str]:
    """The labels that bind whoever takes the least restrictive way to meet a licence expression.

    Of two sides of ``or`` the one whose most restrictive label is milder is taken; of sides
    alike in that the one with fewer labels, then the first in the alphabet.  A way is as
    restrictive as its most restrictive part, so choosing at each ``or`` is choosing overall,
    and no ways are listed.
    """
    stack: list[tuple[int, int, list[str]]] = []  # restriction, number of labels, labels
    for token in postfix(expression):
        if token == "with":
            stack.pop()  # the exception
            rank, n, labels = stack.pop()
            stack.append((SOFTENED.get(rank, rank), n, labels))
        elif token in BINDING:
            right, left = stack.pop(), stack.pop()
            if token == "or":
                stack.append(min(left, right))
            else:
                both = sorted({*left[2], *right[2]})
                stack.append((max(left[0], right[0]), len(both), both))
        else:
            label = label_of(token)
            stack.append((RESTRICTIVE[label], 1, [label]))
    return frozenset(stack[0][2])


def automaton(phrases: Iterable[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in phrases:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str]):
        self.base, self.notices = base, notices
        self.automaton = automaton({*base, *notices, TAG})

    def scan(self, raw: bytes) -> tuple[int, int, int | None, int | None, set[str], set[str], float, list[tuple[int, str]]]:
        """Words, base places, first and last of them, base labels, all labels, score, and (first word, phrase) of each place."""
        words = raw.translate(WORD_BYTES).split()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")  # a character for each byte
        places = [(end - len(phrase) - 1, phrase) for end, phrase in self.automaton.iter(line)]
        if not places:
            return len(words), 0, None, None, set(), set(), 0.0, []
        starts = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32)
        found = [(int(np.searchsorted(starts, at)), phrase) for at, phrase in places]
        at_base = [w for w, phrase in found if phrase in self.base]
        base = {self.base[p] for _, p in found if p in self.base}
        longest: dict[int, str] = {}  # of notices that start at one word
        for at, phrase in found:
            if phrase in self.notices and len(phrase) > len(longest.get(at, "")):
                longest[at] = phrase
        labels = base | {self.notices[p] for p in longest.values()}
        score = 0.9 if base else 0.7 if labels else 0.0
        if any(p == TAG for _, p in found):
            for match in TAG_IN_TEXT.finditer(raw.lower()):
                try:
                    labels |= evaluate(match[1].decode("utf-8", "replace"))
                    score = 1.0
                except ValueError:  # a malformed expression gives no labels
                    score = max(score, 0.5)
        return len(words), len(at_base), min(at_base, default=None), max(at_base, default=None), base, labels, score, found


def scan(docs: DataFrame, base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICE_PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences in each whole text.

    Returns ``doc_id``, ``n_words``, ``n_base`` (places of base phrases), ``first_word``,
    ``last_word`` (of their starts; null without any), ``base_labels``, ``labels`` (sorted arrays; of
    a tag those that its expression comes to),
    ``score`` and ``places``, an array of (word, phrase).  The score is 1 for a tag with a
    valid expression, 0.9 for a base phrase, 0.7 for another notice, 0.5 for a malformed tag (also one
    that is followed by prose, which gives no labels) and else 0.  An identifier that is not known has the label ``unknown``.  Null counts as the empty text, repeated rows and null ids give a row each,
    an empty table none.  Rows stay where they are.
    """
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, score double, places array<struct<word: bigint, phrase: string>>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        place = pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string())]))
        kinds: Sequence[pa.DataType] = [*[pa.int64()] * 4, *[pa.list_(pa.string())] * 2, pa.float64(), place]
        for batch in batches:
            rows = [scanner.scan(text.as_py() or b"") for text in batch.column(1)]
            rows = [(*r[:4], sorted(r[4]), sorted(r[5]), r[6], [{"word": w, "phrase": p} for w, p in r[7]]) for r in rows]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)
