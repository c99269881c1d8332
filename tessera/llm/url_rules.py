"""URL rules as a sort-merge range join.

The canonical key of a host is its labels in reverse, each closed by a dot, so that a host and all its subdomains are
exactly the keys that start with the host's key: the interval [key, key with its last dot replaced by the next
character). Intervals of different rules are nested or disjoint. URLs are dealt to cells by range over key, path and
page (so that a host of a third of all rows spreads over many cells), a rule goes to every cell that its interval
touches, and each cell is swept in key order with a stack of the rules that are open; the rules of one host share a
stack entry that finds the longest fitting path by length. Memory is the stack: the rules of one host and its parents.

The cell bounds come from a bounded sample (SAMPLE keys per cell); they decide balance, never results.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows

SAMPLE = 32
KEY_CHARS = 256


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (after the first :// up to / ? # or the end, A-Z lower-cased) and path (then up to ? or #); both empty for null or no ://."""
    at = F.locate("://", F.coalesce(F.col(url), F.lit("")))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


class Node:
    """The rules of one host: the longest whose path starts the URL's path."""

    def __init__(self, key: str, size: int):
        self.key, self.size, self.paths, self.lengths = key, size, {}, []

    def add(self, path: str, rule: str, verdict: str) -> None:
        known = self.paths.get(path)
        if known is None or verdict == "block":
            self.paths[path] = (rule, verdict)
        self.lengths = sorted({len(p) for p in self.paths}, reverse=True) if known is None else self.lengths

    def find(self, path: str) -> tuple[int, tuple[str, str]] | None:
        for n in self.lengths:
            hit = self.paths.get(path[:n]) if n <= len(path) else None
            if hit:
                return self.size + n, hit
        return None


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", cells: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url).

    rules has verdict (allow or block), host and path. A rule fits its host and all subdomains if the URL's path starts
    with its path; of several the one with the longest host and path together wins, then the one with the longer host;
    of rules with the same host and path block wins. Without a rule: null and the default. Null or empty urls have
    empty host and path and fit only rules with an empty host. Repeated rows are each judged; other columns are ignored.
    """
    spark = pages.sparkSession
    urls = split_url(pages.select(F.col("page_id").cast("long"), "url")).select("page_id", "host", "path")
    cells = cells or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = pages.count()
    fraction = min(1.0, SAMPLE * cells / max(total, 1))
    sample = [f"{host_key(r.host)}\0{r.path}\0{r.page_id}"[:KEY_CHARS] for r in urls.select(*(F.substring(c, 1, KEY_CHARS).alias(c) for c in ("host", "path")), "page_id").sample(fraction, seed=7).limit(2 * SAMPLE * cells).collect()]
    sample.sort()
    bounds = sorted({sample[k * len(sample) // cells] for k in range(1, cells)}) if sample else []
    side = "cell int, key string, kind int, page_id long, host string, path string, verdict string"

    def urls_in(rows: Iterator[tuple]) -> Iterator[tuple]:
        for page_id, host, path in rows:
            key = host_key(host)
            yield bisect_right(bounds, f"{key}\0{path}\0{page_id}"), key, 1, page_id, host, path, None

    def rules_in(rows: Iterator[tuple]) -> Iterator[tuple]:
        for verdict, host, path in rows:
            key = host_key(host)
            for cell in range(bisect_right(bounds, key), bisect_right(bounds, key[:-1] + "/") + 1):
                yield cell, key, 0, None, host, path, verdict

    def sweep(rows: Iterator[tuple]) -> Iterator[tuple]:
        at, stack = None, []
        for cell, key, kind, page_id, host, path, verdict in rows:
            if cell != at:
                at, stack = cell, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1].key != key:
                    stack.append(Node(key, len(host)))
                stack[-1].add(path, host + path, verdict)
                continue
            best = None
            for node in reversed(stack):
                hit = node.find(path)
                if hit and (best is None or hit[0] > best[0]):
                    best = hit
            rule, said = best[1] if best else (None, default)
            yield page_id, host, path, rule, said

    lower = F.translate(F.coalesce("host", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    named = rules.select("verdict", lower.alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    both = map_rows(urls, urls_in, side).unionByName(map_rows(named, rules_in, side))
    return map_rows(both.repartition("cell").sortWithinPartitions("cell", "key", "kind"), sweep, "page_id long, host string, path string, rule string, verdict string")
