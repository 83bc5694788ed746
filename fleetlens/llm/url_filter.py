"""URL filter: all glob rules at once over each URL, by a bit-parallel Shift-And automaton.

The rules stand one after the other in a row of bits, 64 to a machine word, one bit per literal or ``?`` and one start
bit per rule. A bit is set while the characters read so far match the rule up to there. Reading a character shifts all
bits by one, across word borders, and masks them with the bits that accept it; a star keeps the bit before it set. All
URLs of a batch step together, so a step is a few array operations over URLs x words, whatever the number of rules.

A rule reads the canonical URL: a dot, the host, a separator, the path. In a rule, ``*`` is any run of characters,
``+`` any run that stays before the separator (inside the host), ``?`` one byte of UTF-8. Rules start at the first character; at the end they must have read the whole URL.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#``
or the end. A null URL, or one without ``://``, has an empty host and path; no host rule fits it and no glob matches its
empty form, so it is allowed. Repeated rows are judged each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.session import documents
from fleetlens.llm.words import LOWER, UPPER, sql_lower_az

SEPARATOR = 0xFF  # no byte of UTF-8 text

# Fixed values: (verdict, host, path); a rule fits its host and all subdomains, and paths that start with its path.
HOST_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

# The method's own rules: (host glob, path glob) to block where no host rule fits.
BLOCK_GLOBS = [
    ("+spam-farm+", "*"), ("+.casino.+", "*"), ("+.casino", "*"), ("+casino-+", "*"), ("+-casino+", "*"), ("+poker-+", "*"),
    ("+.ads.+", "*"), ("+.adserver.+", "*"), ("+.doubleclick.net", "*"), ("+.track.+", "*"), ("+.tracker.+", "*"),
    ("+.malware.+", "*"), ("+.phish.+", "*"), ("+free-download+", "*"), ("+.xxx", "*"), ("+.porn.+", "*"), ("+porn-+", "*"),
    ("+", "*/wp-login.php*"), ("+", "*/wp-admin/*"), ("+", "*/cgi-bin/*"), ("+", "*/phpmyadmin/*"), ("+", "*/xmlrpc.php"),
    ("+", "*/ads/*"), ("+", "*/adserver/*"), ("+", "*/banner-????.html"), ("+", "*/track/click*"), ("+", "*/redirect/*"),
    ("+", "*/calendar/????/??/*"), ("+", "*/print/*/print/*"), ("+", "*.exe"), ("+", "*.zip"), ("+", "*.apk"), ("+", "*.torrent"),
    ("+", "*/login"), ("+", "*/signin"), ("+", "*/logout"), ("+", "*/cart/*"), ("+", "*/checkout/*"), ("+", "*/basket/*"),
]


class Automaton:
    """Masks of all patterns: pieces of bytes, with the marks ``*``, ``+`` and ``?``."""

    def __init__(self, patterns: list[bytes]):
        bits, accept, loops, starts, ends = 0, [], [], [], []
        for pattern in patterns:
            starts.append(bits)
            accept.append(None)  # the start bit accepts no character
            bits += 1
            for b in pattern:
                if b in b"*+":
                    loops.append((bits - 1, b))
                else:
                    accept.append(b)
                    bits += 1
            ends.append(bits - 1)
        self.words = bits // 64 + 1
        self.start = self._mask(starts)
        self.ends = np.array(ends)
        self.any_loop = self._mask([i for i, b in loops if b == ord("*")])
        self.host_loop = self._mask([i for i, b in loops if b == ord("+")])
        wild = self._mask([i for i, b in enumerate(accept) if b == ord("?")])
        self.read = np.zeros((256, self.words), np.uint64)
        self.keep = np.zeros((256, self.words), np.uint64)
        for c in range(256):
            self.read[c] = self._mask([i for i, b in enumerate(accept) if b == c and b != ord("?")]) | (0 if c == SEPARATOR else wild)
            self.keep[c] = self.any_loop | (0 if c == SEPARATOR else self.host_loop)

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in bits:
            out[i // 64] |= np.uint64(1 << (i % 64))
        return out

    def matches(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each text between two places of ``at``: which patterns read it whole."""
        n, length = len(at) - 1, np.diff(at)
        order = np.argsort(-length, kind="stable")  # the texts still being read are the first ones
        begin, left = at[:-1][order], length[order]
        state = np.tile(self.start, (n, 1))
        live = n
        for step in range(int(left[0]) if n else 0):
            live = int(np.searchsorted(-left, -step, "left"))
            c = data[begin[:live] + step]
            s = state[:live]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.read[c]) | (s & self.keep[c])
        hit = (state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty((n, len(self.ends)), bool)
        out[order] = hit.astype(bool)
        return out


def _pattern(host: str, path: str) -> bytes:
    return f".{host}".encode() + bytes([SEPARATOR]) + path.encode()


def judge(
    urls: DataFrame, id_col: str = "page_id", url_col: str = "url",
    host_rules: list[tuple[str, str, str]] | None = None, globs: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """One row per row of ``urls``: id, host, path, rule, verdict. The longest fitting host rule decides, else the globs."""
    host_rules = HOST_RULES if host_rules is None else host_rules
    globs = BLOCK_GLOBS if globs is None else globs
    # A host rule fits ".host" itself and any "+.host"; the leading dot of the canonical URL makes both "+.host".
    patterns = [b"+" + _pattern(h, p + "*") for _, h, p in host_rules] + [_pattern(h, p) for h, p in globs]
    if any(set(f"{h}{p}") & set("*+?") for _, h, p in host_rules):
        raise ValueError("host rules are literal")
    names = [h + p for _, h, p in host_rules]
    by_length = sorted(range(len(names)), key=lambda i: (-len(names[i]), names[i]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(patterns)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            texts = [b"." + h.encode() + bytes([SEPARATOR]) + p.encode() for h, p in zip(hosts, paths)]
            at = np.cumsum([0, *map(len, texts)])
            hit = auto.matches(np.frombuffer(b"".join(texts), np.uint8), at)
            named = np.full(len(texts), -1)
            for i in reversed(by_length):
                named[hit[:, i]] = i
            blocked = hit[:, len(names) :].any(axis=1)
            rule = [names[i] if i >= 0 else None for i in named.tolist()]
            verdict = [host_rules[i][0] if i >= 0 else "block" if b else "allow" for i, b in zip(named.tolist(), blocked.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    after = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://(.*)$", 1).alias("_after")
    parts = urls.select(F.col(id_col).alias("page_id"), after).select(
        "page_id",
        F.translate(F.regexp_extract("_after", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("_after", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    kind = parts.schema["page_id"].dataType.simpleString()
    return parts.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir, "pages"))


def _like(glob: str) -> str:
    return glob.replace("+", "%").replace("*", "%").replace("?", "_")


_FITS = "\n       ".join(
    f"WHEN ('.' || host) LIKE '%.{h}' AND starts_with(path, '{p}') THEN '{h}{p}'"
    for _, h, p in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
)
_BLOCKED = "\n    OR ".join(f"(('.' || host) LIKE '.{_like(h)}' AND path LIKE '{_like(p)}')" for h, p in BLOCK_GLOBS)
_VERDICTS = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in HOST_RULES)
SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     b AS (SELECT page_id, {sql_lower_az("regexp_extract(rest, '^[^/?#]*')")} AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
     c AS (SELECT *, CASE {_FITS} END AS rule FROM b)
SELECT page_id, host, path, rule, CASE rule {_VERDICTS} ELSE CASE WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END END AS verdict
FROM c
"""

QUERIES = {"op10_url_filter": (op10_url_filter, SQL)}
