"""URL rules in a sorted digest array.

Rules are kept as two sorted arrays of 64-bit xxhash keys in one file each, with the full strings
beside them: the hosts that have rules (with the path lengths of their rules), and the rules
themselves (host and path). The files go to the executors with ``SparkContext.addFile`` and are
memory-mapped there, so all workers of a machine share their pages and a long list needs no heap.
A batch of URLs probes every suffix of its hosts, then for the hosts found every path length in
use, each by one vectorised binary search. A probe that meets a key is confirmed against the
stored string, and neighbours with the same key are tried too, so a collision of digests never
gives a wrong verdict.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table

#: Fixed values: (verdict, host, path) of the rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
DEFAULT = "allow"


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
    from there up to ``?``, ``#`` or the end. Null or no ``://``: both empty."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    rest = rest.partition("?")[0].partition("#")[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


class DigestArray:
    """Sorted 64-bit keys of strings, with strings and values side by side, in memory-mapped files."""

    PARTS = ("keys", "offsets", "strings")

    def __init__(self, prefix: str, digest=xxhash.xxh3_64_intdigest):
        load = lambda name, kind: (np.memmap(f"{prefix}.{name}", kind, "r")
                                   if os.path.getsize(f"{prefix}.{name}") else np.zeros(0, kind))
        self.keys, self.offsets = load("keys", "<u8"), load("offsets", "<u8")
        self.strings, self.digest = load("strings", np.uint8), digest

    @classmethod
    def write(cls, prefix: str, entries: Iterable[tuple[str, str]], digest=xxhash.xxh3_64_intdigest) -> None:
        """(string, value) pairs; of repeated strings the last one counts."""
        rows = sorted((digest(s.encode()), s.encode(), v.encode()) for s, v in dict(entries).items())
        ends = np.cumsum([0, *(len(x) for r in rows for x in r[1:])], dtype="<u8")  # string, value, string, ...
        with open(f"{prefix}.keys", "wb") as f:
            f.write(np.array([r[0] for r in rows], "<u8").tobytes())
        with open(f"{prefix}.offsets", "wb") as f:
            f.write(ends.tobytes())
        with open(f"{prefix}.strings", "wb") as f:
            f.write(b"".join(r[1] + r[2] for r in rows))

    def entry(self, i: int) -> tuple[bytes, bytes]:
        a, b, c = (int(x) for x in self.offsets[2 * i: 2 * i + 3])
        return self.strings[a:b].tobytes(), self.strings[b:c].tobytes()

    def probe(self, strings: list[str]) -> list[str | None]:
        """The values of the strings, None where a string is not stored."""
        raw = [s.encode() for s in strings]
        keys = np.fromiter(map(self.digest, raw), "<u8", len(raw))
        at = np.searchsorted(self.keys, keys)
        out: list[str | None] = [None] * len(raw)
        inside = np.flatnonzero(at < len(self.keys))
        for i in inside[self.keys[at[inside]] == keys[inside]].tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:  # the same digest: confirm the string
                stored, value = self.entry(j)
                if stored == raw[i]:
                    out[i] = value.decode()
                    break
                j += 1
        return out


def ship_rules(spark: SparkSession, rules=RULES, digest=xxhash.xxh3_64_intdigest) -> str:
    """Writes the rules' arrays and gives them to the executors; returns their name."""
    name, folder = f"rules-{uuid.uuid4().hex}", tempfile.mkdtemp()
    lengths: dict[str, set[int]] = {}
    for _, host, path in rules:
        lengths.setdefault(host, set()).add(len(path))
    hosts = [(h, ",".join(map(str, sorted(n, reverse=True)))) for h, n in lengths.items()]
    for kind, entries in (("hosts", hosts), ("rules", [(host + path, verdict) for verdict, host, path in rules])):
        DigestArray.write(f"{folder}/{name}.{kind}", entries, digest)
        for part in DigestArray.PARTS:
            spark.sparkContext.addFile(f"{folder}/{name}.{kind}.{part}")
    return name


def suffixes(host: str) -> list[str]:
    """The host and its parent domains, longest first."""
    out = [host]
    while "." in host:
        host = host.partition(".")[2]
        out.append(host)
    return out


def judge_urls(urls: list[str | None], hosts: DigestArray, rules: DigestArray, default: str = DEFAULT):
    """(host, path, rule, verdict) of each url; the longest rule that fits wins."""
    parsed = [host_and_path(u) for u in urls]
    of_host = {h: suffixes(h) for h in {h for h, _ in parsed}}
    names = list({s for chain in of_host.values() for s in chain})
    known = {s: [int(n) for n in v.split(",")] for s, v in zip(names, hosts.probe(names), strict=True) if v is not None}
    tried = [sorted({s + path[:n] for s in of_host[host] for n in known.get(s, ()) if len(path) >= n},
                    key=lambda r: (-len(r), r)) for host, path in parsed]
    candidates = list({c for row in tried for c in row})
    verdicts = {c: v for c, v in zip(candidates, rules.probe(candidates), strict=True) if v is not None}
    for (host, path), row in zip(parsed, tried, strict=True):
        rule = next((c for c in row if c in verdicts), None)
        yield host, path, rule, verdicts[rule] if rule is not None else default


_opened: dict[str, tuple[DigestArray, DigestArray]] = {}


def filter_urls(pages: DataFrame, rules=RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``pages`` -> (id, host, path, rule, verdict), one row for each row.

    A rule fits its host and all subdomains when the path starts with the rule's; the longest wins;
    without one ``rule`` is null and the verdict is ``default`` (the list does not hold the url).
    Null urls and urls without ``://`` have empty host and path. Null or repeated ids come out as
    they are; an empty table gives no rows; other columns are not read. Very long urls only cost
    their own probes: one for each label of the host and path length in use.
    """
    name = ship_rules(pages.sparkSession, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _opened:
            _opened[name] = tuple(DigestArray(SparkFiles.get(f"{name}.{kind}")) for kind in ("hosts", "rules"))
        hosts, index = _opened[name]
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                found = list(judge_urls(part.column(1).to_pylist(), hosts, index, default))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([f[k] for f in found], pa.string()) for k in range(4))],
                    names=[id_col, "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col).mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def oracle_sql() -> str:
    """The same verdicts by plain string comparison."""
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
WITH rules(verdict, host, path) AS (VALUES {listed}),
cut AS (
  SELECT row_number() OVER () AS n, page_id,
         CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN
              regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0) ELSE '' END AS rest
  FROM pages),
parsed AS (
  SELECT n, page_id,
         translate(regexp_extract(rest, '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(regexp_extract(rest, '^[^/]*', 0)) + 1) AS path
  FROM cut),
best AS (
  SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict
FROM parsed LEFT JOIN best USING (n)
"""
