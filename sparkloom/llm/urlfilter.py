"""URL filters: a trie over reversed host labels, then path segments.

An entry such as ``example.com/shop`` covers its host with all subdomains, and
its path with all below it. Of the entries that cover a URL, the one of the most
host labels decides, of those the one of the most path segments; at one and the
same place an allow entry beats a block entry.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table, widened

#: The list in use; host[/path], and what it says.
ENTRIES: list[tuple[str, str]] = [
    ("spam-farm.example.org", "block"),
    ("cheap-pills.example.com", "block"),
    ("m.example.net", "block"),
    ("spam-farm.example.org/en", "allow"),
    ("spam-farm.example.org/en/7", "block"),
    ("www.cheap-pills.example.com/de", "allow"),
    ("example.net/fr", "block"),
    ("example.net/es", "block"),
    ("blog.example.net", "allow"),
    ("blog.example.com", "block"),
]
#: The trie is sent to the executors if its entries have so many bytes at most; beyond,
#: they are joined. Its arrays take about three times as much.
TRIE_BYTES = 32 << 20
_HOST, _REST = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\\s]+)", r"([^?#]*)"


def parts(url: str | None) -> tuple[list[str], list[str]] | None:
    """Host labels from the right, and path segments; None if it isn't a URL with
    a host. User, port, final dots, query and fragment don't count; the host is
    lower-cased, empty segments are left out (an empty host label isn't)."""
    m = re.match(_HOST + _REST, url or "", re.ASCII)
    host = re.sub(r":[0-9]*$", "", m[1].rpartition("@")[2]).lower().rstrip(".") if m else ""
    if not host:
        return None
    return host.split(".")[::-1], [s for s in m[2].split("/") if s]


class Trie:
    """Nodes are numbers, the root is 0. An arc leads from a node by a label to a
    node; those of host labels and those of path segments are apart. Arcs are
    sorted arrays, so that all URLs of a batch take a step at once."""

    def __init__(self, entries: Iterable[tuple[str, str]]):
        self.entries, self.verdicts = [], []
        said, arcs, words = {}, ({}, {}), {}
        for entry, verdict in entries:
            host, _, path = entry.partition("/")
            node = 0
            for kind, steps in enumerate((host.lower().strip(".").split(".")[::-1], [s for s in path.split("/") if s])):
                for label in steps:
                    node = arcs[kind].setdefault((node, words.setdefault(label, len(words))), len(arcs[0]) + len(arcs[1]) + 1)
            if verdict == "allow" or node not in said:
                said[node] = len(self.entries)
                self.entries.append(entry)
                self.verdicts.append(verdict)
        self.words = pa.array(list(words), pa.string())
        self.said = np.full(len(arcs[0]) + len(arcs[1]) + 1, -1, np.int64)
        self.said[list(said)] = list(said.values())
        self.keys, self.to = [], []
        for each in arcs:
            key = np.array([n << 32 | w for n, w in each], np.int64)
            order = np.argsort(key)
            self.keys.append(key[order])
            self.to.append(np.array(list(each.values()), np.int64)[order])

    def _step(self, kind: int, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where an arc leads from each node, -1 where there is none."""
        keys = self.keys[kind]
        if not len(keys):
            return np.full(len(node), -1)
        wanted = node << 32 | word
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((word >= 0) & (keys[at] == wanted), self.to[kind][at], -1)

    def _labels(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the labels of all rows (-1: not in the trie), and where each row's start."""
        ids = pc.fill_null(pc.index_in(lists.flatten(), self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        return ids, np.concatenate([[0], np.cumsum(n)])

    def match(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        """Of each row the number of the entry that decides, -1 if none covers it."""
        labels, at = self._labels(pc.split_pattern(host, "."))
        segments, first = self._labels(pc.split_pattern(path, "/"))
        full = pc.not_equal(pc.split_pattern(path, "/").flatten(), "").to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(full)])
        segments, first = segments[full], upto[first]
        best = np.full(len(host), -1)
        rows, node = np.arange(len(host)), np.zeros(len(host), np.int64)
        for depth in range(int(np.diff(at).max(initial=0))):
            there = at[rows + 1] - 1 - depth >= at[rows]
            rows, node = rows[there], node[there]
            node = self._step(0, node, labels[at[rows + 1] - 1 - depth])
            rows, node = rows[node >= 0], node[node >= 0]
            if not len(rows):
                break
            here, left, below = self.said[node], np.arange(len(rows)), node
            for k in range(int((first[rows + 1] - first[rows]).max(initial=0))):
                there = first[rows[left]] + k < first[rows[left] + 1]
                left, below = left[there], below[there]
                below = self._step(1, below, segments[first[rows[left]] + k])
                left, below = left[below >= 0], below[below >= 0]
                if not len(left):
                    break
                here[left] = np.where(self.said[below] >= 0, self.said[below], here[left])
            best[rows] = np.where(here >= 0, here, best[rows])
        return best

    def said_of(self, urls: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(verdict, entry) of each of the URLs."""
        found = pc.extract_regex(urls, f"(?s){_HOST.replace('(', '(?P<host>', 1)}{_REST.replace('(', '(?P<path>', 1)}")
        host = pc.fill_null(pc.struct_field(found, "host"), "")
        host = pc.replace_substring_regex(pc.replace_substring_regex(host, "(?s)^.*@", ""), ":[0-9]*$", "")
        host = pc.utf8_rtrim(pc.utf8_lower(host), ".")
        hit = self.match(host, pc.fill_null(pc.struct_field(found, "path"), ""))
        bad = pc.equal(host, "").to_numpy(zero_copy_only=False)
        hit[bad] = -1
        names = pa.array([*self.verdicts, "none", "invalid"], pa.string())
        verdict = names.take(pa.array(np.where(bad, len(names) - 1, np.where(hit >= 0, hit, len(names) - 2))))
        return verdict, pa.array(self.entries, pa.string()).take(pa.array(np.where(hit >= 0, hit, 0), mask=hit < 0))


def _joined(rows: DataFrame, entries: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """The same by a join of every cover of every distinct URL with the entries."""
    spark = rows.sparkSession
    if not isinstance(entries, DataFrame):
        entries = spark.createDataFrame(list(entries), "entry string, verdict string")
    clean = F.split("entry", "/", 2)
    listed = entries.select(
        F.regexp_replace(F.lower(clean[0]), r"^\.+|\.+$", "").alias("h"),
        F.array_join(F.filter(F.split(F.coalesce(F.get(clean, F.lit(1)), F.lit("")), "/"), lambda s: s != ""), "/").alias("p"),
        "entry", "verdict",
    )
    one, two = (F.regexp_extract("url", _HOST + _REST, i) for i in (1, 2))
    host = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(one, r"(?s)^.*@", ""), r":[0-9]*$", "")), r"\.+$", "")

    def heads(array: str, sep: str, least: int) -> Column:
        n = F.size(array)
        return F.transform(F.sequence(F.lit(least), n), lambda i: F.array_join(F.slice(array, 1, i), sep))

    urls = rows.select("url").distinct().withColumn("host", host)
    covers = (
        urls.where("host <> ''")
        .withColumn("labels", F.reverse(F.split("host", r"\.")))
        .withColumn("segments", F.filter(F.split(two, "/"), lambda s: s != ""))
        .select("url", F.posexplode(heads("labels", ".", 1)).alias("hd", "rh"), "segments")
        .select("url", "hd", F.array_join(F.reverse(F.split("rh", r"\.")), ".").alias("h"), F.posexplode(heads("segments", "/", 0)).alias("pd", "p"))
    )
    hit = covers.join(listed, ["h", "p"]).groupBy("url").agg(
        F.max(F.struct("hd", "pd", (F.col("verdict") == "allow").alias("first"), "verdict", "entry")).alias("hit")
    )
    found = urls.join(hit, "url", "left").select(
        F.col("url").alias("u"),
        F.when(F.col("url").isNull() | (F.col("host") == ""), "invalid").otherwise(F.coalesce("hit.verdict", F.lit("none"))).alias("verdict"),
        F.col("hit.entry").alias("entry"),
    )
    return rows.join(found, F.col("url").eqNullSafe(F.col("u"))).drop("u")


def classify(
    pages: DataFrame, entries: list[tuple[str, str]] | DataFrame = ENTRIES, id_col: str = "page_id", url_col: str = "url", most: int = TRIE_BYTES
) -> DataFrame:
    """(page_id, url, verdict, entry): what the deciding entry says of each page.

    ``verdict`` is allow, block, none (no entry covers it) or invalid (null, empty
    or not a URL with a host). One row for each row that comes in, repeated rows
    too; an empty label within a host is a label like others. Other columns are
    left out, whatever their names. Entries of up to ``most`` bytes are sent to the
    executors as a trie, and no row is shuffled; more are joined, with the same
    result (held against each other on random hosts)."""
    rows = pick(pages, id_col, url_col).toDF("page_id", "url").withColumn("url", F.col("url").cast("string"))
    if isinstance(entries, DataFrame):
        listed = entries.select("entry", "verdict")
        if (listed.agg(F.sum(F.octet_length("entry") + 8)).first()[0] or 0) > most:
            return _joined(rows, listed)
        entries = [tuple(r) for r in listed.collect()]
    elif sum(len(e.encode()) + 8 for e, _ in entries) > most:
        return _joined(rows, entries)
    trie = rows.sparkSession.sparkContext.broadcast(Trie(sorted(entries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *trie.value.said_of(batch.column("url"))], names=["page_id", "url", "verdict", "entry"])

    return rows.mapInArrow(run, widened(rows, verdict="string", entry="string"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "pages"))


def oracle_sql(entries: list[tuple[str, str]] = ENTRIES) -> str:
    values = ", ".join(f"('{e}', '{v}')" for e, v in entries)
    return f"""
    WITH listed AS (
      SELECT entry, verdict, lower(split_part(entry, '/', 1)) AS h,
             list_filter(string_split(entry, '/')[2:], lambda s: s <> '') AS p
      FROM (VALUES {values}) t(entry, verdict)),
    u AS (
      SELECT DISTINCT url,
        rtrim(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#\\\\\\s]+)([^?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '.') AS host,
        list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#\\\\\\s]+)([^?#]*)', 2), '/'), lambda s: s <> '') AS seg
      FROM pages),
    hits AS (
      SELECT url, verdict, entry, row_number() OVER (PARTITION BY url ORDER BY len(string_split(h, '.')) DESC, len(p) DESC, (verdict = 'allow') DESC, entry DESC) AS k
      FROM u JOIN listed ON (host = h OR ends_with(host, '.' || h)) AND len(seg) >= len(p) AND (len(p) = 0 OR seg[1:len(p)] = p))
    SELECT page_id, pages.url AS url,
      CASE WHEN pages.url IS NULL OR u.host = '' THEN 'invalid' ELSE coalesce(hits.verdict, 'none') END AS verdict, hits.entry AS entry
    FROM pages LEFT JOIN u ON pages.url IS NOT DISTINCT FROM u.url LEFT JOIN hits ON hits.url = pages.url AND k = 1
    """
