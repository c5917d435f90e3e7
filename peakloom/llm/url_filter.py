"""Operator 11: judge urls by allow and block entries, the longest that fits winning.

Entries are compiled into one trie over reversed host labels, each of whose hosts carries a trie over path
segments, and the trie is broadcast. An entry fits its host and every subdomain, if the url's path starts with
the entry's. Of several that fit, the one with the most host labels wins, then the one with the longest path.
Only a list of at most ``TRIE_BYTES`` is compiled and broadcast; a longer one is joined, with equal results.

Cases: a null url, or one without ``://``, has an empty host and path; an empty host fits no entry. Without a fitting
entry a url is allowed if it has a host and blocked if it has none. An entry that is in both lists blocks; repeated
entries count once; an entry of empty host fits nothing. Ports and user names are part of the host as they stand.
Null and shared page ids are kept, each row is judged alone; other columns are left out; an empty table gives an
empty result, an empty list leaves every url to the last rule.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRIE_BYTES = 4 << 20  # text of the entries that are compiled and broadcast; the trie takes some ten times as much
ENTRY = "host string, path string, verdict string"

Entry = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + F.lit(3), F.char_length(url))), F.lit(""))


class Trie:
    """Host labels from the last one on; ``paths`` of a host holds its entries by whole path segments.

    The last segment of an entry is a prefix (``/en`` fits ``/english``), so a path node keeps its entries by
    that remainder, and the lengths that occur.
    """

    def __init__(self, entries: Iterable[Entry]):
        self.root: dict = {}
        for host, path, verdict in entries:
            if not host:
                continue
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            ends = node.setdefault("ends", {})
            if ends.get(rest, ("", ""))[1] != "block":
                ends[rest] = (host + path, verdict)
            node["lengths"] = sorted({*node.get("lengths", ()), len(rest)}, reverse=True)

    def hosts(self, host: str) -> list[dict]:
        """The path tries of the host and of the domains above it, the longest first."""
        found, node = [], self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                found.append(node["paths"])
        return found[::-1]

    @staticmethod
    def fit(node: dict, path: str) -> tuple[str, str] | None:
        """The entry with the longest path that ``path`` starts with."""
        best, at = None, 0
        while True:
            end = path.find("/", at)
            segment = path[at:] if end < 0 else path[at:end]
            ends = node.get("ends")
            if ends:
                for n in node["lengths"]:
                    # a remainder holds no slash, so it lies in this segment
                    if n <= len(segment) and segment[:n] in ends:
                        best = ends[segment[:n]]
                        break
            node = None if end < 0 else node.get("segments", {}).get(segment)
            if node is None:
                return best
            at = end + 1

    def judge(self, nodes: list[dict], path: str) -> tuple[str, str] | tuple[None, None]:
        for node in nodes:
            if found := self.fit(node, path):
                return found
        return None, None


def judge_urls(pages: DataFrame, entries: list[Entry] | DataFrame, id_col: str = "page_id", url_col: str = "url", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict). ``entries``: (host, path, "allow" or "block") rows."""
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = _by_trie(urls, _small(entries)) if _bytes(entries) <= trie_bytes else _by_join(urls, _frame(pages.sparkSession, entries))
    last = F.when(F.col("host") == "", "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", last).alias("verdict"))


def _bytes(entries: list[Entry] | DataFrame) -> int:
    if isinstance(entries, DataFrame):
        return entries.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 16), F.lit(0))).first()[0]
    return sum(len(host.encode()) + len(path.encode()) + 16 for host, path, _ in entries)


def _small(entries: list[Entry] | DataFrame) -> list[Entry]:
    """The entries in the driver; their size has been checked."""
    return [tuple(r) for r in entries.select("host", "path", "verdict").collect()] if isinstance(entries, DataFrame) else entries


def _frame(spark: SparkSession, entries: list[Entry] | DataFrame) -> DataFrame:
    return entries if isinstance(entries, DataFrame) else spark.createDataFrame(entries, ENTRY)


def _by_trie(urls: DataFrame, entries: list[Entry]) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(Trie(entries))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = shared.value, {}
        for batch in batches:
            rules, verdicts = [], []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                if host not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[host] = trie.hosts(host)
                rule, verdict = trie.judge(known[host], path)
                rules.append(rule)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], [*batch.schema.names, "rule", "verdict"])

    kind = dict(urls.dtypes)["page_id"]
    return urls.mapInArrow(rows, f"page_id {kind}, host string, path string, rule string, verdict string")


def _by_join(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """Every domain above a host with every folder of its path, joined to the entries of that domain and folder.

    Only as many labels and folders are listed as the entries have at most. Different urls are judged once.
    """
    folder = F.regexp_extract("path", r"^(?s)(.*/)?", 0)
    lists = entries.where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("folder", folder)  # "block" is the larger
    lists = lists.select("folder", F.col("host").alias("domain"), F.col("path").alias("start"), "verdict")
    most = lists.agg(F.max(F.size(F.split("domain", r"\."))).alias("labels"), F.max(F.size(F.split("folder", "/"))).alias("folders")).first()
    labels, folders = most["labels"] or 0, most["folders"] or 0
    names, parts = F.split("host", r"\."), F.split("path", "/")
    domains = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))), lambda n: F.array_join(F.slice(names, -n, n), "."))
    heads = F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(folders)) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.when(n > 0, "/").otherwise("")))
    different = urls.where("host <> ''").select("host", "path").distinct()
    asked = different.select("host", "path", F.explode(domains).alias("domain")).select("host", "path", "domain", F.explode(F.array_distinct(heads)).alias("folder")) if labels else different.select("host", "path", F.col("host").alias("domain"), F.col("path").alias("folder")).limit(0)
    fits = asked.join(lists, ["domain", "folder"]).where(F.startswith("path", "start"))
    order = F.struct(F.size(F.split("domain", r"\.")), F.char_length("start"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("domain", "start").alias("rule"), "verdict"), order).alias("best"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", "best.rule", "best.verdict")
