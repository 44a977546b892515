"""Licence scans: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates
the licence expressions behind the tags."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from peaklane.llm.names import own_names
from peaklane.llm.words import PLAIN_BLANK, words

#: Phrases and labels that every scan has. Fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further phrases and labels.
PHRASES = {
    "apache license": "apache",
    "mit license": "mit",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons": "cc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
}
TAG = "spdx license identifier"
#: How much a label restricts reuse, from 0 to 1.
LIMITS = {"cc0": 0.0, "public-domain": 0.0, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "apache": 0.1, "cc-by": 0.2, "cc": 0.3, "mpl": 0.4, "epl": 0.4, "lgpl": 0.5, "cc-by-sa": 0.6, "gpl": 0.7, "agpl": 0.8, "cc-by-nc": 0.9, "cc-by-nd": 0.9, "reserved": 1.0}
#: Identifiers of public licences, lower-case, by how much they restrict. Fixed values; families with versions follow below.
IDENTIFIERS = {
    0.0: "0bsd blessing cc0-1.0 cc-pddc mit-0 pddl-1.0 unlicense wtfpl sax-pd",
    0.1: """aal afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 apache-1.0 apache-1.1 apache-2.0 apafml app-s2p artistic-1.0 artistic-1.0-perl
        artistic-2.0 beerware bittorrent-1.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-2-clause-views bsd-3-clause
        bsd-3-clause-attribution bsd-3-clause-clear bsd-3-clause-lbnl bsd-3-clause-modification bsd-4-clause bsd-4-clause-uc
        bsd-source-code bsl-1.0 bzip2-1.0.6 clartistic cnri-python curl ecl-1.0 ecl-2.0 efl-2.0 fsfap fsful ftl hpnd ibm-pibs icu ijg
        imagemagick intel isc jasper-2.0 json libpng libpng-2.0 libtiff linux-openib lucida-bitmap-fonts mit mit-cmu mit-advertising
        mit-enna mit-feh mit-modern-variant mulanpsl-1.0 mulanpsl-2.0 naist-2003 ncsa net-snmp nist-pd ntp oldap-2.8 openssl
        php-3.0 php-3.01 plexus postgresql psf-2.0 python-2.0 python-2.0.1 ruby sgi-b-2.0 smlnj ssh-openssh tcl tcp-wrappers tu-berlin-2.0
        unicode-3.0 unicode-dfs-2015 unicode-dfs-2016 upl-1.0 vim w3c w3c-19980720 x11 xfree86-1.1 xnet zed zend-2.0 zlib
        zlib-acknowledgement zpl-2.0 zpl-2.1""",
    0.2: "cdla-permissive-1.0 cdla-permissive-2.0 odc-by-1.0 ofl-1.0 ofl-1.1",
    0.4: """cddl-1.0 cddl-1.1 cecill-b cecill-c cpal-1.0 cpl-1.0 epl-1.0 epl-2.0 erlpl-1.1 ipl-1.0 lppl-1.0 lppl-1.2 lppl-1.3a lppl-1.3c
        mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl npl-1.0 npl-1.1 sissl spl-1.0""",
    0.7: "cecill-1.0 cecill-2.0 cecill-2.1 eupl-1.0 eupl-1.1 eupl-1.2 gfdl-1.1 gfdl-1.2 gfdl-1.3 osl-1.0 osl-2.0 osl-2.1 osl-3.0 qpl-1.0 rpl-1.5 sleepycat cdla-sharing-1.0 odbl-1.0",
    0.9: "busl-1.1 elastic-2.0 sspl-1.0 polyform-noncommercial-1.0.0 polyform-small-business-1.0.0",
}
#: Exceptions that loosen a licence. Fixed values.
EXCEPTIONS = set("""389-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0
    clisp-exception-2.0 digirule-foss-exception ecos-exception-2.0 fawkes-runtime-exception fltk-exception font-exception-2.0
    freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gnu-javamail-exception gpl-3.0-linking-exception gpl-cc-1.0
    i2p-gpl-java-exception lgpl-3.0-linking-exception libtool-exception linux-syscall-note llvm-exception lzma-exception
    ocaml-lgpl-linking-exception openjdk-assembly-exception-1.0 openvpn-openssl-exception qt-gpl-exception-1.0 qt-lgpl-exception-1.1
    qwt-exception-1.0 u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1""".split())
_LIMIT = {name: limit for limit, names in IDENTIFIERS.items() for name in names.split()}
_FAMILY = re.compile(r"(agpl|lgpl|gpl|cc-by-nc-sa|cc-by-nc-nd|cc-by-nc|cc-by-nd|cc-by-sa|cc-by)-\d[0-9.]*(?:-only|-or-later|-[a-z]{2,3})?")
_ORDER = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[^\s()]+")


def limit_of(identifier: str) -> float | None:
    """How much a licence identifier restricts; None for one that isn't known."""
    name = identifier.rstrip("+")
    if (limit := _LIMIT.get(name)) is not None:
        return limit
    family = _FAMILY.fullmatch(name)
    return (LIMITS.get(family[1]) or LIMITS[family[1][:8]]) if family else None


def leading_expression(line: str) -> str:
    """The longest beginning of a lower-case line that is a licence expression: after the first identifier only known ones
    continue it, so that prose and comment signs behind a tag don't. Empty if there is none, or if a parenthesis stays open."""
    depth, operand, exception, stop = 0, True, False, 0
    for m in _TOKEN.finditer(line):
        token = m[0]
        if token == "(":
            if not operand or exception:
                break
            depth += 1
        elif token == ")":
            if operand or not depth:
                break
            depth -= 1
        elif token in _ORDER:
            if operand:
                break
            operand, exception = True, token == "with"
        elif not operand or (token not in EXCEPTIONS if exception else stop and limit_of(token) is None):
            break
        else:
            operand = exception = False
        if not operand and not depth:
            stop = m.end()
    return "" if depth else line[:stop]


def evaluate(expression: str) -> float | None:
    """The limit of a lower-case licence expression: the least of alternatives (or), the greatest of parts (and), and
    a known exception (with) takes 0.2 off; an identifier that isn't known counts as 0.5. None if it is no expression."""
    values: list[float] = []
    pending: list[str] = []

    def reduce() -> bool:
        op = pending.pop()
        if op == "(" or len(values) < 2:
            return False
        b, a = values.pop(), values.pop()
        values.append(min(a, b) if op == "or" else max(a, b) if op == "and" else max(0.0, a - b))
        return True

    operand = True
    for token in _TOKEN.findall(expression):
        if token == "(":
            if not operand:
                return None
            pending.append(token)
        elif token == ")":
            if operand:
                return None
            while pending and pending[-1] != "(":
                if not reduce():
                    return None
            if not pending:
                return None
            pending.pop()
        elif token in _ORDER:
            if operand:
                return None
            while pending and pending[-1] != "(" and _ORDER[pending[-1]] >= _ORDER[token]:
                if not reduce():
                    return None
            pending.append(token)
            operand = True
        else:
            if not operand:
                return None
            if pending and pending[-1] == "with":
                values.append(0.2 if token in EXCEPTIONS else 0.0)
            else:
                values.append(0.5 if (limit := limit_of(token)) is None else limit)
            operand = False
    if operand:
        return None
    while pending:
        if not reduce():
            return None
    return values[0]


def _labels_of(expression: str, limit: float | None) -> set[str]:
    if limit is None:
        return {"spdx-invalid"}
    names = [t for t in _TOKEN.findall(expression) if t not in _ORDER and t not in "()" and t not in EXCEPTIONS]
    unknown = {"spdx-unknown"} if any(limit_of(t) is None for t in names) else set()
    return unknown if len(unknown) == len(set(names)) else unknown | {"spdx-permissive" if limit < 0.3 else "spdx-weak" if limit < 0.6 else "spdx-strong"}


@functools.cache
def _automaton(phrases: tuple[tuple[str, str, bool], ...]):
    """Of each phrase its labels, as (label, whether it is a base one, words): base ones and a caller's stay side by side."""
    import ahocorasick

    found, told = ahocorasick.Automaton(), {}
    for phrase, label, base in (*phrases, (TAG, "", False)):
        own = told.setdefault(phrase, [])
        if all(label != known for known, *_ in own):
            own.append((label, base, len(phrase.split())))
    for phrase, own in told.items():
        found.add_word(f" {phrase} ", own)
    found.make_automaton()
    return found


_EXPRESSION = re.compile(rb"[ \t:]*([a-z0-9.+\-() \t]*)")


@own_names("text")
def license_scan(docs: DataFrame, *, text: str = "text", base: dict[str, str] = BASE, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``docs`` with n_words, matches (label, is_base, start and end word), expressions (text, limit), labels and score.

    Words are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. ``matches`` are in the
    order of their ends; every place counts, overlaps too, and ``phrases`` add labels to those of ``base``. ``expressions``: what follows a tag, as far as it is a licence
    expression, or else the rest of its line. ``labels``: distinct and sorted, of the phrases and of the expressions
    (``spdx-permissive``, ``spdx-weak``, ``spdx-strong``; ``spdx-unknown`` if an identifier isn't known, ``spdx-invalid`` for
    what can't be parsed). ``score``: the greatest limit of the labels and expressions; 0 if there are none.

    Null and empty texts have no words. Rows are scanned one by one, so repeated rows and very long texts need no care; an
    empty table stays empty. Columns named like a new one are replaced.
    """
    listed = tuple((p, lab, b) for group, b in ((base, True), (phrases, False)) for p, lab in group.items())
    match = T.StructType([T.StructField("label", T.StringType()), T.StructField("is_base", T.BooleanType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    expression = T.StructType([T.StructField("text", T.StringType()), T.StructField("limit", T.DoubleType())])
    added = [T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(match)), T.StructField("expressions", T.ArrayType(expression)), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType())]
    docs = docs.drop(*[f.name for f in added])
    at = docs.columns.index(text)
    arrow = [pa.int64(), pa.list_(pa.struct([("label", pa.string()), ("is_base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.struct([("text", pa.string()), ("limit", pa.float64())])), pa.list_(pa.string()), pa.float64()]

    def scan(batches):
        automaton = _automaton(listed)
        for batch in batches:
            w = words(batch.column(at), seed=3, lower=True, blank=PLAIN_BLANK)
            raw, into = w.packed(np.ones(len(w.start), bool))
            hits = [(e, *v) for e, own in automaton.iter(" " + raw.decode("latin-1")) for v in own]
            last = np.searchsorted(into, np.array([h[0] for h in hits], np.int64), "left") - 1
            owner = np.searchsorted(w.first, last, "right") - 1
            matches: list[list] = [[] for _ in range(batch.num_rows)]
            told: list[list] = [[] for _ in range(batch.num_rows)]
            data = w.data.tobytes() if any(not h[1] for h in hits) else b""
            for (_, label, is_base, size), end, d in zip(hits, last.tolist(), owner.tolist(), strict=True):
                if end - size + 1 < w.first[d]:  # it began in the document before
                    continue
                if label:
                    first = int(w.first[d])
                    matches[d].append({"label": label, "is_base": is_base, "start": end - size + 1 - first, "end": end + 1 - first})
                else:
                    stop = int(w.end[w.first[d + 1] - 1])
                    line = _EXPRESSION.match(data, int(w.end[end]), stop)[1].decode().strip()
                    line = leading_expression(line) or line
                    told[d].append({"text": line, "limit": evaluate(line)})
            labels, scores = [], []
            for m, x in zip(matches, told, strict=True):
                limits = [e["limit"] for e in x]
                names = {p["label"] for p in m}.union(*[_labels_of(e["text"], e["limit"]) for e in x])
                labels.append(sorted(names))
                scores.append(max([0.0, *(LIMITS.get(p["label"], 0.5) for p in m), *(v for v in limits if v is not None)]))
            new = [np.diff(w.first), matches, told, labels, scores]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, t) for v, t in zip(new, arrow, strict=True)]], names=[*batch.schema.names, *[f.name for f in added]])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, *added]))
