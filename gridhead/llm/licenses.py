"""Licence notices and identifier tags in texts, and what the licences they name ask for.

A text is its UTF-8 bytes: A-Z become lower case, and words are runs of digits, letters a-z and bytes from 0x80 (so
text that is no valid UTF-8 is read as well). An Aho-Corasick automaton finds all phrases in one pass over the words.
Identifier tags are followed by an expression, and notices that are joined by `and`, `or` or `with` form one; both are
put in postfix order by a shunting-yard parser and evaluated: `or` takes the milder side, `and` the stricter one, and
an exception (`with`) makes a licence no stricter than a weak copyleft.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhead.llm.common import with_key

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licences and how much they restrict reuse, from 0 (nothing asked) to 1 (no use without leave).
LICENCES = {
    "0bsd": 0.0, "cc0-1.0": 0.0, "public-domain": 0.0, "unlicense": 0.0, "wtfpl": 0.0,
    "apache": 0.2, "apache-1.1": 0.2, "apache-2.0": 0.2, "artistic-2.0": 0.2, "bsd": 0.2, "bsd-2-clause": 0.2, "bsd-3-clause": 0.2, "bsl-1.0": 0.2, "cc-by": 0.2, "cc-by-3.0": 0.2, "cc-by-4.0": 0.2, "isc": 0.2, "mit": 0.2, "mit-0": 0.1, "python-2.0": 0.2, "zlib": 0.2,
    "cddl-1.0": 0.5, "epl-1.0": 0.5, "epl-2.0": 0.5, "lgpl": 0.5, "lgpl-2.0": 0.5, "lgpl-2.1": 0.5, "lgpl-3.0": 0.5, "mpl-1.1": 0.5, "mpl-2.0": 0.5, "ofl-1.1": 0.5,
    "cc-by-sa": 0.7, "cc-by-sa-3.0": 0.7, "cc-by-sa-4.0": 0.7, "gfdl-1.3": 0.7, "gpl": 0.7, "gpl-1.0": 0.7, "gpl-2.0": 0.7, "gpl-3.0": 0.7,
    "agpl": 0.8, "agpl-3.0": 0.8,
    "cc-by-nc": 0.9, "cc-by-nc-3.0": 0.9, "cc-by-nc-4.0": 0.9, "cc-by-nc-sa": 0.9, "cc-by-nc-sa-4.0": 0.9, "cc-by-nc-nd": 0.9, "cc-by-nc-nd-4.0": 0.9, "cc-by-nd": 0.9, "cc-by-nd-4.0": 0.9,
    "reserved": 1.0,
}
EXCEPTIONS = {"autoconf-exception-3.0", "bison-exception-2.2", "classpath-exception-2.0", "gcc-exception-3.1", "linux-syscall-note", "llvm-exception", "openssl-exception"}
# Notices, in words, and the licence or exception that each names.
NOTICES = {
    "apache license": "apache", "apache license 2 0": "apache-2.0", "apache license version 2 0": "apache-2.0", "apache 2 0": "apache-2.0",
    "bsd license": "bsd", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "boost software license": "bsl-1.0",
    "cc0": "cc0-1.0", "cc by 3 0": "cc-by-3.0", "cc by 4 0": "cc-by-4.0", "cc by sa": "cc-by-sa", "cc by sa 3 0": "cc-by-sa-3.0", "cc by sa 4 0": "cc-by-sa-4.0", "cc by nd": "cc-by-nd", "cc by nd 4 0": "cc-by-nd-4.0",
    "cc by nc": "cc-by-nc", "cc by nc 3 0": "cc-by-nc-3.0", "cc by nc 4 0": "cc-by-nc-4.0", "cc by nc sa": "cc-by-nc-sa", "cc by nc sa 4 0": "cc-by-nc-sa-4.0", "cc by nc nd": "cc-by-nc-nd", "cc by nc nd 4 0": "cc-by-nc-nd-4.0",
    "creative commons attribution": "cc-by", "creative commons attribution 4 0": "cc-by-4.0", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc",
    "eclipse public license": "epl-2.0", "mozilla public license": "mpl-2.0", "isc license": "isc", "mit license": "mit", "zlib license": "zlib",
    "gnu affero general public license": "agpl-3.0", "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl-2.0", "gnu lgpl": "lgpl", "gnu gpl": "gpl", "gnu free documentation license": "gfdl-1.3",
    "gnu general public license": "gpl", "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0", "gnu general public license v2": "gpl-2.0", "gnu general public license v3": "gpl-3.0",
    "released into the public domain": "public-domain", "dedicated to the public domain": "public-domain", "the unlicense": "unlicense",
    "classpath exception": "classpath-exception-2.0", "llvm exception": "llvm-exception", "gcc runtime library exception": "gcc-exception-3.1",
}
# Tags that an expression follows.
TAGS = ("spdx license identifier", "license expression", "packagelicensedeclared", "packagelicenseconcluded")

#: Words that may stand beside the one operator between two notices of an expression.
FILLERS = {"the", "a", "an", "either", "both", "of", "under", "terms"}
#: Precedence of the operators.
OPERATORS = {"or": 1, "and": 2, "with": 3}
#: The label of a tag whose expression names no licence that is known here.
UNKNOWN = "unknown"
EXCEPTED = 0.5

_SPACED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TOKEN = re.compile(rb"[A-Za-z0-9][A-Za-z0-9.+:-]*|[()]")
#: An expression ends with its line or string, and is never longer than this.
_MARK = re.compile(rb"[ \t]*[\"']?[ \t]*[:=][ \t]*[\"']?")
_EXPRESSION, _LONGEST = re.compile(rb"[^\r\n\"'<>*;]*"), 4096

FINDING = "array<struct<word:bigint,n_words:int,expression:string,restriction:double>>"


class Finding(NamedTuple):
    """An expression in a text: its first word (from 0), its words, and its value."""

    word: int
    n_words: int
    expression: str
    restriction: float
    labels: frozenset[str]


def known(name: str) -> str | None:
    """The licence, exception or reference that an identifier names."""
    low = name.lower().rstrip(".:")
    if low in LICENCES or low in EXCEPTIONS or low.startswith(("licenseref-", "documentref-")):
        return low
    plain = re.sub(r"(\+|-only|-or-later)$", "", low)
    return plain if plain in LICENCES else None


def postfix(tokens: list[str]) -> list[str]:
    """The longest leading expression of the tokens in postfix order: operands, `and`, `or`, `with` and parentheses.

    What cannot continue an expression ends it; an operator without a right side is dropped, open parentheses are closed.
    """
    output: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in tokens:
        low = token.lower()
        if operand_next and token == "(":
            waiting.append(token)
        elif operand_next:
            name = None if low in OPERATORS or token == ")" else known(token)
            if name is None:
                break
            output.append(name)
            operand_next = False
        elif low in OPERATORS:
            while waiting and waiting[-1] != "(" and OPERATORS[waiting[-1]] >= OPERATORS[low]:
                output.append(waiting.pop())
            waiting.append(low)
            operand_next = True
        elif token == ")" and "(" in waiting:
            while (top := waiting.pop()) != "(":
                output.append(top)
        else:
            break
    while operand_next and waiting:  # empty parentheses, then the operator before them
        operand_next = waiting.pop() == "("
    output += (w for w in reversed(waiting) if w != "(")
    return output


def evaluated(order: list[str]) -> tuple[str, float]:
    """A postfix expression written out, and how much it restricts reuse."""
    stack: list[tuple[str, float]] = []
    for token in order:
        if token not in OPERATORS:
            stack.append((token, LICENCES.get(token, 0.0 if token in EXCEPTIONS else 1.0)))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        value = min(a, b) if token == "or" else max(a, b) if token == "and" else min(a, EXCEPTED)
        stack.append((f"({left} {token.upper()} {right})", value))
    return stack[0]


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in dict.fromkeys([*BASE, *NOTICES, *TAGS]):
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def _operand(phrase: str) -> str | None:
    return NOTICES.get(phrase) or BASE.get(phrase)


def _tagged(text: bytes, at: int) -> tuple[list[str], str, float] | None:
    """Postfix order, text and value of the expression that stands in the text after a tag; none without a colon or equals sign."""
    mark = _MARK.match(text, at)
    if mark is None:
        return None
    line = _EXPRESSION.match(text, mark.end()).group()[:_LONGEST]
    order = postfix([t.decode() for t in _TOKEN.findall(line)])
    return (order, *evaluated(order)) if order else ([], UNKNOWN, 1.0)


class Scan(NamedTuple):
    """What a text holds: words, first words of base phrases, their labels, and findings in order."""

    n_words: int
    places: np.ndarray
    base: frozenset[str]
    findings: list[Finding]


def scan_text(text: bytes) -> Scan:
    """All base phrases, tags and notices of a whole text; of notices that overlap, the first and longest counts."""
    flat = np.frombuffer(b" " + text.translate(_SPACED) + b" ", np.uint8)
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 32) | (flat[:-1] != 32)
    words = flat[keep].tobytes().decode("latin-1")
    hits = [(end - len(phrase) - 1, phrase) for end, phrase in _automaton().iter(words)]
    if not hits:
        return Scan(max(words.count(" ") - 1, 0), np.zeros(0, np.int64), frozenset(), [])
    gaps = np.flatnonzero(flat[keep] == 32)
    first = dict(zip((s for s, _ in hits), np.searchsorted(gaps, [s for s, _ in hits]).tolist(), strict=True))
    base = [(first[s], p) for s, p in hits if p in BASE]
    picked: list[tuple[int, str]] = []
    for start, phrase in sorted(hits, key=lambda h: (h[0], -len(h[1]))):
        if not picked or start > picked[-1][0] + len(picked[-1][1]):
            picked.append((start, phrase))
    findings: list[Finding] = []
    place = np.flatnonzero(keep) if any(p in TAGS for _, p in picked) else None
    done = -1
    i = 0
    while i < len(picked):
        start, phrase = picked[i]
        i += 1
        if phrase in TAGS:
            # the byte after the tag: the place of the blank behind it, less the blank that was put in front
            tagged = _tagged(text, int(place[start + len(phrase) + 1]) - 1)
            if tagged is None:
                continue
            order, expression, value = tagged
            size = len(phrase.split()) + sum(len(re.findall("[a-z0-9]+", o)) for o in order)
            findings.append(Finding(first[start], size, expression, value, frozenset(o for o in order if o not in OPERATORS) or frozenset([UNKNOWN])))
            done = first[start] + size
            continue
        if first[start] < done:  # named by the tag before it
            continue
        tokens, last = [_operand(phrase)], start + len(phrase)
        while i < len(picked) and picked[i][1] not in TAGS:
            between = words[last + 1 : picked[i][0]].split() if picked[i][0] - last < 80 else []
            joint = [w for w in between if w in OPERATORS]
            if len(joint) != 1 or any(w not in FILLERS for w in between if w not in OPERATORS):
                break
            tokens += [joint[0], _operand(picked[i][1])]
            last = picked[i][0] + len(picked[i][1])
            i += 1
        order = postfix(tokens)
        size = words.count(" ", start, last + 1)
        findings.append(Finding(first[start], size, *evaluated(order), frozenset(o for o in order if o not in OPERATORS)))
    return Scan(max(len(gaps) - 1, 0), np.array([w for w, _ in base], np.int64), frozenset(BASE[p] for _, p in base), findings)


def _scanned(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(7)]
        for text in batch.column(1):
            found = scan_text(text.as_py() or b"")
            labels = found.base.union(*(f.labels for f in found.findings))
            row = (
                found.n_words,
                len(found.places),
                int(found.places.min()) if len(found.places) else None,
                int(found.places.max()) if len(found.places) else None,
                sorted(found.base),
                sorted(labels),
                [f._asdict() for f in found.findings],
            )
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        arrays = [pa.array(c, schema.field(i + 1).type) for i, c in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *schema.names[1:]])


def scan(docs: DataFrame) -> DataFrame:
    """Per document: `doc_id, n_words, n_base, first_word, last_word, base_labels, labels, findings, score`.

    `n_base` counts all places of base phrases and `first_word`, `last_word` are the first words of the first and last
    of them (null if there are none); labels are sorted arrays of different texts. `score` is the greatest restriction of
    the findings: 0 if there are none or they ask nothing, 1 if all rights are reserved or a tag names no known licence.

    A null text is an empty one; a text that is no valid UTF-8 is read as its bytes. A row per row of `docs`: repeated
    or null ids stay as they are, an empty table gives an empty one, and further columns, whatever their names, are not read.
    Nothing is shuffled, and a task holds one batch and a few copies of its longest text.
    """
    kinds = {
        "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.list_(pa.string()), "labels": pa.list_(pa.string()),
        "findings": pa.list_(pa.struct([("word", pa.int64()), ("n_words", pa.int32()), ("expression", pa.string()), ("restriction", pa.float64())])),
    }
    schema = pa.schema([("doc_id", pa.null()), *kinds.items()])
    texts = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text"))
    out = with_key(docs, "doc_id", f"n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, findings {FINDING}")
    found = texts.mapInArrow(lambda batches: _scanned(batches, schema), out)
    return found.withColumn("score", F.coalesce(F.array_max(F.transform("findings", lambda f: f["restriction"])), F.lit(0.0)))
