"""URL filter: one bit-parallel wildcard automaton for all glob rules.

Rules are packed into multiword Shift-And masks; one pass over the bytes of a canonical URL
(host and path) advances every rule at once, and all URLs of a batch advance together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loanlens.llm.text import LOWER, pieces, utf8

#: The rules of the url query (host, path prefix).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Where no rule fits: an example list of names in the host that mark link farms and pharmacies, for callers to replace; else allow.
HOST_NAMES = ("spam", "pills", "casino")
DEFAULT = "allow"

_U = np.uint64


def domain_globs(rule: str) -> tuple[str, str]:
    """Globs for 'this host and its subdomains, path starting with the rule's'."""
    return f"{rule}**", f"*.{rule}**"


def host_globs(names: Sequence[str]) -> list[str]:
    """Globs for hosts that hold one of the names, without a path and with any."""
    return [g for n in names for g in (f"*{n}*", f"*{n}*/**")]


@dataclass
class Automaton:
    """Glob patterns over bytes: ``*`` is any run without ``/``, ``**`` any run at all.

    Bit i of the state says that so many elements of its pattern are read.  A wildcard is a
    self loop on the bit before it.  ``step[c]`` are the bits that byte c may enter from the
    bit below, ``loop[c]`` those that it may stay on.
    """

    start: np.ndarray
    step: np.ndarray
    loop: np.ndarray
    accept: np.ndarray  # word and bit of each pattern's last state
    settled: np.ndarray  # bits that no byte can clear

    @classmethod
    def compile(cls, globs: Sequence[str]) -> Automaton:
        states: list[tuple[int, set[int]]] = []  # byte that enters (-1: a start), bytes that loop
        last: list[int] = []
        any_byte, in_host = set(range(256)), set(range(256)) - {ord("/")}
        for glob in globs:
            states.append((-1, set()))
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i] == ord("*"):
                    double = raw[i:i + 2] == b"**"
                    states[-1][1].update(any_byte if double else in_host)
                    i += 1 + double
                else:
                    states.append((raw[i], set()))
                    i += 1
            last.append(len(states) - 1)
        words = max(1, -(-len(states) // 64))
        start, step, loop = np.zeros(words, _U), np.zeros((256, words), _U), np.zeros((256, words), _U)
        settled = np.zeros(words, _U)
        for k, (enter, stay) in enumerate(states):
            w, bit = divmod(k, 64)
            mask = _U(1 << bit)
            if enter < 0:
                start[w] |= mask
            else:
                step[enter, w] |= mask
            loop[sorted(stay), w] |= mask
            if len(stay) == 256 and k in last:
                settled[w] |= mask
        return cls(start, step, loop, np.array([divmod(k, 64) for k in last], np.int64).reshape(-1, 2), settled)

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each pattern matches each whole string: (strings, patterns)."""
        n = len(offsets) - 1
        state = np.tile(self.start, (n, 1))
        length = np.diff(offsets)
        live = np.flatnonzero(length > 0)
        at = 0
        while len(live):
            c = data[offsets[live] + at]
            s = state[live]
            moved = s << _U(1)
            moved[:, 1:] |= s[:, :-1] >> _U(63)
            s = (moved & self.step[c]) | (s & self.loop[c])
            state[live] = s
            at += 1
            # no later byte changes a row that only holds settled bits (or none)
            live = live[(length[live] > at) & np.any(s & ~self.settled, axis=1)]
        return (state[:, self.accept[:, 0]] >> self.accept[:, 1].astype(_U) & _U(1)).astype(bool)


def canonical(column: pa.Array) -> tuple[list[bytes], list[bytes]]:
    """Host (A-Z lower-cased) and path of each URL; null or no ``://``: both empty."""
    hosts, paths = [], []
    lower = LOWER.tobytes()
    data, offsets = utf8(column)
    raw = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        url = raw[a:b]
        _, found, rest = url.partition(b"://")
        if not found:
            hosts.append(b"")
            paths.append(b"")
            continue
        ends = [k for k in (rest.find(b"?"), rest.find(b"#")) if k >= 0]
        rest = rest[: min(ends)] if ends else rest
        host, slash, path = rest.partition(b"/")
        hosts.append(host.translate(lower))
        paths.append(slash + path)
    return hosts, paths


def url_filter(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES, globs: Sequence[str] | None = None, default: str = DEFAULT) -> DataFrame:
    """One row for each row of ``pages``: key, host, path, rule, verdict.

    ``rules`` are (verdict, host/path); a rule fits its host and all subdomains if the path
    starts with the rule's, and the longest fitting rule decides (of equally long ones the
    first by name).  Else rule is null and the method's own globs decide: block if one of
    ``globs`` (by default those of HOST_NAMES) matches host and path or the URL has no host, else
    ``default``.  Null, empty
    and malformed URLs have empty host and path; repeated rows are judged each; a null key stays.
    """
    order = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    automaton = Automaton.compile([g for _, r in order for g in domain_globs(r)] + list(host_globs(HOST_NAMES) if globs is None else globs))
    names, verdicts = np.array([r for _, r in order] + [None], object), np.array([v for v, _ in order], object)
    k = len(order)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "url"):
                hosts, paths = canonical(part.column("url"))
                whole = [h + p for h, p in zip(hosts, paths)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in whole])]).astype(np.int64)
                hit = automaton.run(np.frombuffer(b"".join(whole), np.uint8), offsets)
                fits = hit[:, 0: 2 * k: 2] | hit[:, 1: 2 * k: 2]
                which = np.where(fits.any(1), fits.argmax(1) if k else 0, k)
                own = np.where(hit[:, 2 * k:].any(1) | np.array([not h for h in hosts], bool), "block", default).astype(object)
                verdict = np.where(which < k, np.append(verdicts, None)[which], own)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array([h.decode() for h in hosts], pa.string()), pa.array([p.decode() for p in paths], pa.string()), pa.array(names[which].tolist(), pa.string()), pa.array(verdict.tolist(), pa.string())],
                    [key, "host", "path", "rule", "verdict"])

    schema = f"`{key}` {dict(pages.dtypes)[key]}, host string, path string, rule string, verdict string"
    return pages.selectExpr(f"`{key}` AS key", f"`{url}` AS url").mapInArrow(judge, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` under the fixed rules."""
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, rest FROM u),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
hits AS (
  SELECT p.page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(r.verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, h.rule,
  coalesce(h.verdict, CASE WHEN p.host = '' OR p.host LIKE '%spam%' OR p.host LIKE '%pills%' OR p.host LIKE '%casino%' THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN hits h USING (page_id)
"""
