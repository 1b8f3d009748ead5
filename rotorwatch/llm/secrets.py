"""Secrets in texts: keyword automaton, regular expressions at its hits, embedded checksums.

One Aho-Corasick pass over a text finds the keywords that begin a secret; a regular
expression is then matched at exactly that place. Runs of hexadecimal digits have no keyword,
but a run of n digits covers one of every n places, so only those are looked at. Kinds that
carry a checksum or a readable header are kept only if it holds.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorwatch.llm.rows import text

# The patterns of each kind, and the keywords that a match begins with.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
GITHUB = r"(?:ghp|gho|ghu|ghs|ghr)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"
NPM = r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"
JWT_RUN, JWT_REST = r"[A-Za-z0-9_-]*", r"\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
PEM = r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----[A-Za-z0-9+/=\s]+-----END \1-----"
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"], "jwt": ["eyj"], "pem": ["-----begin "],
}
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE_KINDS = KINDS[:3]
HEX_LEAST, ACCESS_LEAST, ASSIGN_LEAST = 24, 20, 6
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX = frozenset("0123456789abcdef")
_LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}


def checksum(body: str) -> str:
    """CRC-32 of the body as six digits to the base 62."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out


def _readable(head: str) -> bool:
    """The header of a signed web token is JSON that names an algorithm."""
    try:
        raw = base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))
        value = json.loads(raw)
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(value, dict) and "alg" in value


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= ASSIGN_LEAST
    if kind == "access":
        return len(m[0]) >= ACCESS_LEAST
    if kind in ("github", "npm"):
        return m[2] == checksum(m[1])
    return True


@lru_cache
def _scanner():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            auto.add_word(w, (kind, len(w)))
    auto.make_automaton()
    patterns = {
        "assign": re.compile(ASSIGN, re.A | re.I), "access": re.compile(ACCESS), "github": re.compile(GITHUB),
        "npm": re.compile(NPM), "pem": re.compile(PEM, re.A), "run": re.compile(JWT_RUN), "rest": re.compile(JWT_REST),
    }
    return auto, patterns


class _WebTokens:
    """Three runs joined by dots, the first two beginning with ``eyJ``.

    A dot is in no run, so a token's first part ends where its run does, for every place in the run at which
    it may begin. The run's end and what follows are found once, and time grows with the text.
    """

    def __init__(self, s: str):
        self.s, self.lo, self.hi, self.rest = s, 0, 0, None

    def match(self, at: int):
        """End of the token that begins at ``at``, and whether its header can be read; None without one."""
        patterns = _scanner()[1]
        if not self.lo <= at < self.hi:
            self.lo, self.hi = at, patterns["run"].match(self.s, at).end()
            self.rest = patterns["rest"].match(self.s, self.hi)
        if self.rest is None or at + 3 >= self.hi or not self.s.startswith("eyJ", at):
            return None
        return self.rest.end(), _readable(self.s[at:self.hi])


def _lower(s: str) -> str:
    out = s.lower()
    return out if len(out) == len(s) else s.translate(_LOWER)


def _hex_runs(s: str):
    """Runs of at least HEX_LEAST digits."""
    done = 0
    for at in range(HEX_LEAST - 1, len(s), HEX_LEAST):
        if at < done or s[at] not in HEX:
            continue
        a, b = at, at + 1
        while a > done and s[a - 1] in HEX:
            a -= 1
        while b < len(s) and s[b] in HEX:
            b += 1
        if b - a >= HEX_LEAST:
            yield a, b
        done = b


def spans(s: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of every secret by start, then kind; places in code points,
    the end exclusive. Matches of one kind don't overlap."""
    auto, patterns = _scanner()
    out = [("hex", a, b) for a, b in _hex_runs(s)]
    done, tokens = dict.fromkeys(KINDS, 0), _WebTokens(s)
    for last, (kind, n) in auto.iter(_lower(s)):
        at = last - n + 1
        if at < done[kind]:
            continue
        if kind == "jwt":
            if found := tokens.match(at):
                done[kind], good = found
                out += [(kind, at, done[kind])] * good
        elif m := patterns[kind].match(s, at):
            done[kind] = m.end()
            if _valid(kind, m):
                out.append((kind, at, m.end()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts of the three base kinds, ``base_sha256`` over the base
    spans, and ``spans`` of all kinds.

    Null text is empty and has no spans. Every row is scanned whole, repeated rows too, ids
    may be null, and an empty table gives an empty result. Only the two named columns are read.
    """

    def run(batches):
        for batch in batches:
            found = [spans(s) for s in batch.column(1).to_pylist()]
            base = [[x for x in f if x[0] in BASE_KINDS] for f in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                *[pa.array([sum(x[0] == k for x in f) for f in base], pa.int64()) for k in BASE_KINDS],
                pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base], pa.string()),
                pa.array([joined(f) for f in found], pa.string()),
            ], ["_ll_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_ll_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    found = docs.select(F.col(id_col), text(text_col).alias("_ll_text")).mapInArrow(run, schema)
    return found.withColumnRenamed("_ll_id", id_col)
