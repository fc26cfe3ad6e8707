"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed side by side into multiword bit masks. One Shift-And
step per byte advances every rule at once:

    D = ((D << 1) & ENTER[byte]) | (D & STAY[byte])

``ENTER`` holds the states entered by reading the byte, ``STAY`` the states
that a ``*`` lets loop. numpy runs the step for a block of URLs at a time.
A canonical URL is ``.`` + host + byte FF + path; FF never occurs in UTF-8, so
a ``*`` of the host part cannot run into the path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.llm.common import with_workers

#: Rules of the contract: (verdict, host, path); a rule fits its host and all subdomains.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Globs that decide where no rule fits: host part, then (after a slash) path part.
BLOCK_GLOBS = (
    "*.cheap-pills.*",
    "*.spam-farm.*",
    "*.casino-*.*",
    "*.ads-track.*",
    "*.adult-*.*",
    "*.free-bets.*",
    "*.adserver.*",
    "*.doubleclick.*",
    "*/*/wp-admin/*",
    "*/cgi-bin/*",
    "*/*.exe",
)
SPLIT = 0xFF
_BLOCK_BYTES = 4 << 20


def rule_glob(host: str, path: str) -> tuple[str, str, bool]:
    """The (host glob, path glob, open end) of a rule."""
    return f"*.{host}", path, True


def parse_glob(glob: str) -> tuple[str, str, bool]:
    """``host`` or ``host/path`` glob; without a path it fits every path, else the whole path."""
    host, slash, path = glob.partition("/")
    return host, (slash + path) if slash else "", not slash


@dataclass
class Automaton:
    enter: np.ndarray  # 256 x words
    stay: np.ndarray
    start: np.ndarray
    finals: list[tuple[int, int]]  # (word, bit) of each glob's last state

    @classmethod
    def of(cls, globs: list[tuple[str, str, bool]]) -> Automaton:
        """One bit for each glob's start and one for each character it reads."""
        programs = []
        for host, path, tail in globs:
            steps: list[tuple[object, bool]] = []  # (byte or None for any, in host)
            loops: dict[int, bool] = {}  # state -> the loop stays in the host
            for text, in_host in ((host, True), (path, False)):
                for b in text.encode():
                    if b == ord("*"):
                        loops[len(steps)] = in_host
                    else:
                        steps.append((None if b == ord("?") else b, in_host))
                if in_host:
                    steps.append((SPLIT, True))
            if tail:
                loops[len(steps)] = False
            programs.append((steps, loops))
        bits = sum(len(s) + 1 for s, _ in programs)
        words = max(1, -(-bits // 64))
        enter = np.zeros((256, words), np.uint64)
        stay = np.zeros((256, words), np.uint64)
        start = np.zeros(words, np.uint64)
        finals, at = [], 0
        for steps, loops in programs:
            def mark(mask, byte, state, at=at):
                mask[byte, (at + state) // 64] |= np.uint64(1 << ((at + state) % 64))
            start[at // 64] |= np.uint64(1 << (at % 64))
            for k, (byte, _) in enumerate(steps, 1):
                for b in ([byte] if byte is not None else range(SPLIT)):
                    mark(enter, b, k)
            for state in loops:
                for b in range(SPLIT):
                    mark(stay, b, state)
            at += len(steps)
            finals.append((at // 64, at % 64))
            at += 1
        return cls(enter, stay, start, finals)

    def run(self, urls: list[bytes]) -> np.ndarray:
        """Boolean matrix: url x glob."""
        n, words = len(urls), len(self.start)
        out = np.zeros((n, len(self.finals)), bool)
        sizes = np.fromiter(map(len, urls), np.int64, n)
        order = np.argsort(sizes, kind="stable")
        one, top = np.uint64(1), np.uint64(63)
        a = 0
        while a < n:
            b = a + 1
            while b < n and (b + 1 - a) * max(1, sizes[order[b]]) <= _BLOCK_BYTES:
                b += 1
            rows = order[a:b]
            longest = int(sizes[rows[-1]])
            chars = np.zeros((b - a, longest), np.uint8)
            for i, r in enumerate(rows):
                chars[i, : sizes[r]] = np.frombuffer(urls[r], np.uint8)
            live_from = np.searchsorted(sizes[rows], np.arange(longest), side="right")
            state = np.tile(self.start, (b - a, 1))
            for t in range(longest):
                k = live_from[t]
                cur, c = state[k:], chars[k:, t]
                nxt = cur << one
                if words > 1:
                    nxt[:, 1:] |= cur[:, :-1] >> top
                state[k:] = (nxt & self.enter[c]) | (cur & self.stay[c])
            for g, (w, bit) in enumerate(self.finals):
                out[rows, g] = (state[:, w] >> np.uint64(bit)) & one
            a = b
        return out


def split_url(url):
    """Columns (host, path) of a url column; null or no ``://`` gives both empty."""
    u = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(u, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(u, pattern, 2)


def filter_urls(df: DataFrame, id_col: str, url_col: str, rules=RULES, block_globs=BLOCK_GLOBS) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    The longest fitting rule decides (ties: the earlier rule); where none fits,
    a url that any of ``block_globs`` matches is blocked, every other allowed.
    Null urls and urls without ``://`` have an empty host and path, no rule and
    the verdict ``allow``. Repeated rows stay; an empty table gives none; other
    columns of ``df`` are not read, so their names cannot clash. Long urls are
    run whole, in blocks of bounded bytes.
    """
    with_workers(df.sparkSession)
    names = [h + p for _, h, p in rules]
    order = sorted(range(len(rules)), key=lambda i: (-len(names[i]), i))
    globs = [rule_glob(h, p) for _, h, p in rules] + [parse_glob(g) for g in block_globs]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton.of(globs)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hit = auto.run([b"." + h.encode() + b"\xff" + p.encode() for h, p in zip(hosts, paths)])
            rule = np.full(len(hosts), -1)
            for i in reversed(order):
                rule[hit[:, i]] = i
            bad = hit[:, len(rules):].any(axis=1)
            verdict = [rules[r][0] if r >= 0 else "block" if x else "allow" for r, x in zip(rule, bad)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([names[r] if r >= 0 else None for r in rule], pa.string()), pa.array(verdict, pa.string())],
                names=["__id", "host", "path", "rule", "verdict"])

    host, path = split_url(F.col(url_col))
    base = df.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path"))
    kind = base.schema["__id"].dataType.simpleString()
    out = base.mapInArrow(judge, f"__id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("__id", id_col)
