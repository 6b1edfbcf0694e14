"""Licence scans: one Aho-Corasick automaton over normalised words finds notice phrases and identifier tags; a
shunting-yard parser reads the licence expression behind a tag.

Labels are families (``mit``, ``gpl``): a notice rarely tells a version.  Identifiers of one family share its label,
``expressions`` keep them as written.  Of the text behind a tag the longest beginning that is a whole expression of
known identifiers counts; a name that is not known ends it and is reported in ``unknown``, never as a label.

Row by row, no shuffle; repeated rows are scanned each.  Null and empty texts have no words, no labels and score 0, an
empty table gives none.  A text is read whole, in time linear in its length; its bytes are held about four times.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---- fixed values: notice phrases (lower-case words) and the label of each -----------------------------------
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
MORE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "public-domain",
    "sil open font license": "ofl",
    "all rights reserved": "proprietary",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "public domain": "public-domain",
}
# identifiers of the SPDX licence list (lower-case) by label
FAMILIES = {
    "mit": "mit mit-0 mit-advertising mit-cmu mit-feh mit-modern-variant x11",
    "apache-1": "apache-1.0 apache-1.1",
    "apache-2": "apache-2.0",
    "bsd": "0bsd bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause",
    "isc": "isc",
    "zlib": "zlib zlib-acknowledgement",
    "bsl": "bsl-1.0",
    "gpl": "gpl-1.0 gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later",
    "lgpl": "lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later",
    "agpl": "agpl-1.0 agpl-1.0-only agpl-1.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later",
    "mpl": "mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception",
    "epl": "epl-1.0 epl-2.0",
    "eupl": "eupl-1.0 eupl-1.1 eupl-1.2",
    "cddl": "cddl-1.0 cddl-1.1",
    "artistic": "artistic-1.0 artistic-1.0-perl artistic-2.0",
    "python": "psf-2.0 python-2.0",
    "openssl": "openssl",
    "ofl": "ofl-1.0 ofl-1.1",
    "wtfpl": "wtfpl",
    "ms": "ms-pl ms-rl",
    "public-domain": "cc0-1.0 unlicense pddl-1.0",
    "cc-by": "cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0",
    "cc-by-sa": "cc-by-sa-1.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0",
    "cc-by-nd": "cc-by-nd-1.0 cc-by-nd-2.0 cc-by-nd-2.5 cc-by-nd-3.0 cc-by-nd-4.0",
    "cc-by-nc": "cc-by-nc-1.0 cc-by-nc-2.0 cc-by-nc-2.5 cc-by-nc-3.0 cc-by-nc-4.0",
    "cc-by-nc-sa": "cc-by-nc-sa-1.0 cc-by-nc-sa-2.0 cc-by-nc-sa-2.5 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0",
    "cc-by-nc-nd": "cc-by-nc-nd-1.0 cc-by-nc-nd-2.0 cc-by-nc-nd-2.5 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0",
}
EXCEPTIONS = frozenset(
    "389-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 font-exception-2.0 "
    "gcc-exception-2.0 gcc-exception-3.1 libtool-exception linux-syscall-note llvm-exception openssl-exception qt-gpl-exception-1.0 universal-foss-exception-1.0".split()
)
TAG = "spdx license identifier"
# weight of evidence: a tag that names a known licence, a notice of the base list, any other notice, a tag of unknown names
TAG_SCORE, BASE_SCORE, MORE_SCORE, UNKNOWN_SCORE = 1.0, 0.9, 0.6, 0.3
ALLOWED = frozenset({"mit", "apache-2", "bsd", "isc", "zlib", "bsl", "public-domain"})
# ----------------------------------------------------------------------------------------------------------------

LABELS = {name: label for label, names in FAMILIES.items() for name in names.split()}

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_LOWERED = bytes.maketrans(bytes(range(65, 91)) + bytes(set(_SEPARATORS) - set(range(65, 91))), bytes(range(97, 123)) + b" " * (len(_SEPARATORS) - 26))
_SAID = re.compile(rb":[ \t]*([^\r\n]*)")
_WORD = re.compile(rb"[^ ]+")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def normalised(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lower-cased, runs of other ASCII are separators."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWERED).split() if text else []


def label_of(name: str) -> str | None:
    """The label of an identifier, with or without the ``+`` for later versions; None where it is not known."""
    return LABELS.get(name) or LABELS.get(name.removesuffix("+")) or ("licenseref" if re.fullmatch(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+", name) else None)


def postfix(expression: str) -> tuple[list[str], str | None]:
    """Shunting yard: ``with`` binds before ``and`` before ``or``, all to the left.

    The longest beginning that is a whole expression of known names, in postfix order (empty: none), and the unknown
    name that ended the reading, if one did.  An exception is known only behind ``with``, which joins two names.
    """
    out, stack, operand_next, whole, last = [], [], True, [], None
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if operand_next and token == "(" and last != "with":
            stack.append(token)
        elif operand_next and token not in "()" and word not in _BINDS:
            if not (word in EXCEPTIONS if last == "with" else label_of(word)):
                return whole, word
            out.append(word)
            operand_next = False
        elif not operand_next and token == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif not operand_next and word in _BINDS and (word != "with" or last not in (")", "with ")):
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        else:
            break
        last = "with " if last == "with" else word
        if not operand_next and "(" not in stack:
            whole = out + stack[::-1]
    return whole, None


def evaluate(expression: str, allowed: frozenset[str] = ALLOWED) -> tuple[set[str], bool, str | None]:
    """(labels, whether ``allowed`` labels alone satisfy the expression, unknown name); no labels where none is whole.

    ``a with b`` is the label of ``a`` and the exception, and is allowed as ``a`` is: an exception only adds permissions.
    """
    items, unknown = postfix(expression)
    stack: list[tuple[set[str], bool]] = []
    for item in items:
        if item not in _BINDS:
            label = item if item in EXCEPTIONS else label_of(item)
            stack.append(({label}, label in allowed))
            continue
        (right, right_ok), (left, left_ok) = stack.pop(), stack.pop()
        if item == "or":
            stack.append((left | right, left_ok or right_ok))
        elif item == "and":
            stack.append((left | right, left_ok and right_ok))
        else:
            stack.append(({f"{min(left)} with {min(right)}"}, left_ok))
    return (*(stack[0] if stack else (set(), False)), unknown)


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrases, base in ((BASE_PHRASES, True), (MORE_PHRASES, False)):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (phrase, label, base))
    found.add_word(f" {TAG} ", (TAG, None, False))
    found.make_automaton()
    return found


def said_behind(raw: bytes, ends: list[int]) -> Iterator[str]:
    """What stands between the colon behind each of the words ``ends`` (counted from 0, ascending) and the line's end."""
    wanted = iter(ends)
    due = next(wanted, None)
    for k, word in enumerate(_WORD.finditer(raw.translate(_LOWERED))):
        if due is None:
            return
        if k == due:
            said = _SAID.match(raw, word.end())
            if said:
                yield said[1].decode("utf-8", "replace").strip()
            due = next(wanted, None)


def scan(text: str | None, machine: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, expressions, unknown, permitted, score) of one text.

    ``permitted``: every expression is satisfied by allowed licences; null without expressions.
    """
    words = normalised(text)
    if not words:
        return 0, 0, None, None, "", "", [], [], None, 0.0
    line = b" " + b" ".join(words) + b" "
    starts, tags, base_labels, labels, expressions, unknown, permitted, score = [], [], set(), set(), set(), set(), None, 0.0
    for end, (phrase, label, base) in machine.iter(line.decode("latin-1")):
        if label is None:
            tags.append(end)
            continue
        labels.add(label)
        if base:
            starts.append(end - len(phrase))
            base_labels.add(label)
        score = max(score, BASE_SCORE if base else MORE_SCORE)
    places, at, seen = [], 0, -2  # the space before the first word and that behind the tag's last one
    for end in tags:
        seen, at = seen + line.count(b" ", at, end + 1), end + 1
        places.append(seen)
    for said in said_behind(text.encode("utf-8", "surrogatepass"), places):
        found, ok, other = evaluate(said)
        if other:
            unknown.add(other)
            score = max(score, UNKNOWN_SCORE)
        if found:
            labels |= found
            expressions.add(said)
            permitted = ok and permitted is not False
            score = TAG_SCORE
    edge = (line.count(b" ", 0, min(starts)) - 1, line.count(b" ", 0, max(starts)) - 1) if starts else (None, None)
    return len(words), len(starts), *edge, ",".join(sorted(base_labels)), ",".join(sorted(labels)), sorted(expressions), sorted(unknown), permitted, score


_FIELDS = [
    ("n_words", T.LongType(), pa.int64()), ("n_base", T.LongType(), pa.int64()), ("first_word", T.LongType(), pa.int64()),
    ("last_word", T.LongType(), pa.int64()), ("base_labels", T.StringType(), pa.string()), ("labels", T.StringType(), pa.string()),
    ("expressions", T.ArrayType(T.StringType()), pa.list_(pa.string())), ("unknown", T.ArrayType(T.StringType()), pa.list_(pa.string())),
    ("permitted", T.BooleanType(), pa.bool_()), ("score", T.DoubleType(), pa.float64()),
]


def license_scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all others than the results' names) and what ``scan`` finds in each row's text."""
    names = [f[0] for f in _FIELDS]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    chosen = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias("_scanned"))
    schema = T.StructType([f for f in chosen.schema.fields[:-1]] + [T.StructField(n, t) for n, t, _ in _FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            found = [scan(value.as_py(), machine) for value in batch.column(batch.num_columns - 1)]
            columns = [pa.array([row[i] for row in found], kind) for i, (_, _, kind) in enumerate(_FIELDS)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + columns, names=keep + names)

    return chosen.mapInArrow(run, schema)
