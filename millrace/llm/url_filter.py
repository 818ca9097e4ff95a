"""URL filters: a bit-parallel wildcard automaton.

Glob rules (``*`` any run of bytes, ``?`` any one byte, a backslash before a literal one) are packed into one state vector
of 64-bit words. Bit i of a rule means that its first i symbols are matched; a byte moves all rules at once by
D' = ((D << 1) & B[byte]) | (D & LOOP), with carries between words and LOOP holding the states before a ``*``. The state
vectors of a batch of URLs advance together, one byte position at a time, so a step is a few array operations over all
URLs still that long and all rules. A rule matches if its last state is on at the end of the whole canonical URL.

Canonical form: trimmed; scheme, user info, default port, fragment and a leading ``www.`` dropped; host in lower case;
tracking parameters (utm_*, ref, fbclid, gclid) dropped; repeated slashes and a trailing ``/``, ``?`` or ``&`` dropped.
It is made by built-in expressions, and only the URL column is read.

An allow rule overrides block rules. Cases: a NULL URL gives NULL canonical form, matches nothing and is not blocked;
an empty one is canonical as it is and can match ``*``. Any length works: long URLs go on alone once short ones have ended.
Repeated rows are judged alike; an empty table gives an empty table; an empty rule list matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (glob over the canonical URL, action)
RULES = [
    ("*.example.net/*", "block"), ("*.example.net/en/*", "allow"), ("m.*", "block"), ("blog.*.example.com/*/1*", "block"), ("*/de/*.html", "block"),
    ("*/fr/????", "block"), ("*/es/*\\?page=?", "block"), ("*login*", "block"), ("*/admin/*", "block"), ("*.exe", "block"), ("*.zip", "block"),
    ("*casino*", "block"), ("*porn*", "block"), ("*.example.org/en/??", "block"), ("*ng.example.com/*", "block"), ("the*.example.???/*", "block"),
    ("*/fr/2*", "allow"), ("tion*.example.*/*/*7", "block"), ("*sessionid=*", "block"), ("*/*/*/*/*/*", "block"), ("?????.*", "block"), ("*77*", "block"),
]
#: (pattern, replacement), in this order, after trimming; the host's case comes last
STEPS = [
    ("^[A-Za-z][A-Za-z0-9+.-]*://", ""), ("#.*$", ""), ("^[^/?@]*@", ""), ("^([^/?:]*):(80|443)(/|\\?|$)", r"\1\3"), ("^[wW][wW][wW]\\.", ""),
    ("([?&])((utm_[a-z]+|ref|fbclid|gclid)=[^&]*(&|$))+", r"\1"), ("/+", "/"), ("[/?&]+$", ""),
]


def canonical(url: Column) -> Column:
    """The canonical form as an expression."""
    u = F.trim(url)
    for pattern, to in STEPS:
        u = F.regexp_replace(u, F.lit(pattern), F.lit(to.replace("\\", "$")))
    host = F.regexp_extract(u, "^[^/?]*", 0)
    return F.concat(F.lower(host), F.substr(u, F.length(host) + 1))


class Automaton:
    """The packed masks of a list of globs."""

    def __init__(self, globs: list[str]):
        bits, start, last, loops, sets = 0, [], [], [], []
        for g in globs:
            start.append(bits)
            if g.startswith("*"):
                loops.append(bits)
            i, data = 0, g.encode()
            while i < len(data):
                c = data[i : i + 1]
                if c == b"*":
                    loops.append(bits)
                else:
                    bits += 1
                    if c == b"\\" and i + 1 < len(data):
                        i += 1
                        c = data[i : i + 1]
                        sets.append((bits, c[0]))
                    else:
                        sets.append((bits, None if c == b"?" else c[0]))
                i += 1
            last.append(bits)
            bits += 1
        self.words = max(1, -(-bits // 64))
        self.masks = np.zeros((256, self.words), np.uint64)
        for bit, byte in sets:
            self.masks[slice(None) if byte is None else byte, bit >> 6] |= np.uint64(1 << (bit & 63))
        self.start, self.loop = self._vector(start), self._vector(loops)
        self.last = np.array(last, np.int64)

    def _vector(self, bits: list[int]) -> np.ndarray:
        v = np.zeros(self.words, np.uint64)
        for b in bits:
            v[b >> 6] |= np.uint64(1 << (b & 63))
        return v

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """A row a text, a column a rule."""
        n = len(texts)
        size = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-size, kind="stable")
        offset, data = np.concatenate([[0], np.cumsum(size)[:-1]])[order], np.frombuffer(b"".join(texts), np.uint8)
        size = size[order]
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        active = n
        for i in range(int(size[0]) if n else 0):
            active = int(np.searchsorted(-size, -i, side="left"))  # those longer than i
            d = state[:active]
            moved = d << one
            if self.words > 1:
                moved[:, 1:] |= d[:, :-1] >> top
            moved &= self.masks[data[offset[:active] + i]]
            moved |= d & self.loop
            state[:active] = moved
        found = (state[:, self.last >> 6] >> (self.last & 63).astype(np.uint64)) & one
        out = np.empty((n, len(self.last)), bool)
        out[order] = found.astype(bool)
        return out


def _matcher(rules: list[tuple[str, str]]):
    auto, block = Automaton([g for g, _ in rules]), np.array([a == "block" for _, a in rules], bool)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            urls = b.column(1).to_pylist()
            found = auto.matches([(u or "").encode() for u in urls]) & np.array([u is not None for u in urls], bool)[:, None]
            blocked = (found & block).any(axis=1) & ~(found & ~block).any(axis=1)
            ids = [",".join(map(str, np.flatnonzero(r))) for r in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.string()), pa.array(blocked)], ["i", "url", "rules", "blocked"])

    return run


def match_urls(df: DataFrame, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, canonical_url, rules: the numbers of the matching ones, blocked) of every row."""
    kind = df.schema[page_id].dataType.simpleString()
    slim = df.select(F.col(f"`{page_id}`").alias("i"), canonical(F.col(f"`{url}`")).alias("url"))
    done = slim.mapInArrow(_matcher(rules), f"i {kind}, url string, rules string, blocked boolean")
    return done.select(F.col("i").alias("page_id"), F.col("url").alias("canonical_url"), "rules", "blocked")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every page with its canonical URL, the rules it matches and the verdict."""
    return match_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def glob_regex(glob: str) -> str:
    """The same rule as a regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            i += 1
            c = "\\" + c if (c := glob[i]) in ".?*+()[]{}|^$\\" else c
        elif c == "*":
            c = ".*"
        elif c == "?":
            c = "."
        elif c in ".+()[]{}|^$":
            c = "\\" + c
        out += c
        i += 1
    return out


def _oracle() -> str:
    u = "trim(url)"
    for pattern, to in STEPS:
        u = f"regexp_replace({u}, '{pattern}', '{to}', 'g')"
    rules = ", ".join(f"({i}, '{glob_regex(g)}', {a == 'block'})".lower().replace("'" + glob_regex(g).lower(), "'" + glob_regex(g)) for i, (g, a) in enumerate(RULES))
    return f"""
WITH c AS (SELECT row_number() OVER () AS rid, page_id, {u} AS u FROM pages),
p AS (SELECT rid, page_id, lower(regexp_extract(u, '^[^/?]*')) || substr(u, length(regexp_extract(u, '^[^/?]*')) + 1) AS canonical_url FROM c),
r(rule, pattern, block) AS (VALUES {rules}),
m AS (SELECT rid, rule, block FROM p JOIN r ON regexp_full_match(canonical_url, pattern))
SELECT page_id, canonical_url, coalesce(string_agg(rule::VARCHAR, ',' ORDER BY rule), '') AS rules,
  coalesce(bool_or(block), false) AND NOT coalesce(bool_or(NOT block), false) AS blocked
FROM p LEFT JOIN m USING (rid) GROUP BY rid, page_id, canonical_url"""


ORACLE = _oracle()
