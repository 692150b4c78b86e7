"""Stored indexes: versioned Parquet tables, and the JSON exchange format.

A store is a folder with one folder a version and a file ``CURRENT`` that names
the live one. A version is written whole before ``CURRENT`` is replaced, so that
readers never see half of it. Postings are partitioned by hash of the term and
sorted, so that a term's rows lie in few row groups.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.analysis import AlphanumericTokenizer, Analyzer, NoStemmer, PorterStemmer, Stopper
from verdigris.operators.index import DOC_STATS, FEW, POSTINGS, SearchIndex, empty_index
from verdigris.sources.scratch import durable, fresh_path, scope

# Worker functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

JSON_INDEX = "doc_data map<string,struct<slug:string,num_terms:bigint>>, index array<struct<term:string,posting_list:array<struct<doc_id:bigint,postings:array<int>>>>>"


class AnalyzerMismatch(ValueError):
    pass


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


#: Bytes that are copied to a file at once.
PIECE = 1 << 22


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Replace a file in one step."""
    fs, target = _fs(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    _replace(fs, part, target)


def _replace(fs, part, target) -> None:
    if not fs.rename(part, target):  # some file systems don't rename over a file
        fs.delete(target, False)
        fs.rename(part, target)


def _get(spark: SparkSession, path: str) -> str | None:
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    text = bytes(stream.readAllBytes()).decode()
    stream.close()
    return text


def save(index: SearchIndex, path: str, partitions: int | None = None) -> str:
    """Write a new version and make it current; returns its name. ``index`` may
    itself read an earlier version of the same store."""
    spark = index.postings.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    at = f"{path}/{version}"
    with scope(spark):
        # written before it is divided by range, which looks at all keys beforehand
        index = index.stored()
        by_term = index.postings.repartitionByRange(*([partitions] if partitions else []), "term", "doc_id").sortWithinPartitions("term", "doc_id")
        by_term.select("term", "doc_id", "tf", "dl", "positions").write.parquet(f"{at}/postings")
        index.doc_stats.select("doc_id", "slug", "num_terms").write.parquet(f"{at}/doc_stats")
    stored = SearchIndex(spark.read.parquet(f"{at}/postings"), spark.read.parquet(f"{at}/doc_stats"), index.analyzer)
    stored.term_stats.sortWithinPartitions("term").write.parquet(f"{at}/term_stats")
    stored.corpus.coalesce(1).write.parquet(f"{at}/corpus")
    _put(spark, f"{at}/analyzer.json", index.analyzer.manifest())
    _put(spark, f"{path}/CURRENT", version)
    _put(spark, f"{at}/PUBLISHED", version)
    return version


def _analyzer(manifest: dict) -> Analyzer:
    if manifest.get("tokenizer") != "alphanumeric" or manifest.get("stemmer") not in ("porter-1", "none"):
        raise AnalyzerMismatch("the index was built by an analyzer of your own; pass it")
    return Analyzer(AlphanumericTokenizer(manifest["lowercase"]), Stopper(manifest["stopwords"]), PorterStemmer() if manifest["stemmer"] == "porter-1" else NoStemmer())


def load(spark: SparkSession, path: str, analyzer: Analyzer | None = None, version: str | None = None) -> SearchIndex:
    """The current version, or one by name; an empty index if there is none. An
    analyzer other than the one it was built by is refused."""
    version = version or _get(spark, f"{path}/CURRENT")
    if version is None:
        return empty_index(spark, analyzer)
    at = f"{path}/{version}"
    manifest = _get(spark, f"{at}/analyzer.json")
    if analyzer is None:
        analyzer = _analyzer(json.loads(manifest))
    elif analyzer.manifest() != manifest:
        raise AnalyzerMismatch(f"built by {manifest}, opened with {analyzer.manifest()}")
    tables = {t: spark.read.parquet(f"{at}/{t}") for t in ("postings", "doc_stats", "term_stats", "corpus")}
    return SearchIndex(tables["postings"], tables["doc_stats"], analyzer, tables["term_stats"], tables["corpus"])


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete every version that was current once and isn't any more; returns
    their names. One that is still being written stays."""
    current = _get(spark, f"{path}/CURRENT")
    fs, root = _fs(spark, path)
    there = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    old = [name for name in there if name != current and _get(spark, f"{path}/{name}/PUBLISHED") is not None]
    for name in old:
        fs.delete(_fs(spark, f"{path}/{name}")[1], True)
    return old


def check_json_path(path: str) -> str:
    if not str(path).endswith(".json"):
        raise ValueError(f"an index file ends in .json: {path}")
    return str(path)


def lists_to_json(index: SearchIndex) -> DataFrame:
    """``(term, value)``: each term's list as a JSON object of its own, a row a term."""
    lists = index.postings.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("doc_id", F.col("positions").alias("postings")))).alias("posting_list"))
    return lists.select("term", F.to_json(F.struct("term", "posting_list")).alias("value"))


def lists_from_json(rows: DataFrame, value: str = "value") -> DataFrame:
    """``(term, doc_id, tf, positions)`` from rows of such objects."""
    parsed = rows.select(F.from_json(value, "term string, posting_list array<struct<doc_id:bigint,postings:array<int>>>").alias("l"))
    flat = parsed.select("l.term", F.inline("l.posting_list"))
    return flat.select("term", "doc_id", F.size("postings").cast("bigint").alias("tf"), F.col("postings").alias("positions"))


#: The lines of a file that ``export_json`` wrote which aren't of a document or list, and how such a file ends.
OPENING, BETWEEN, CLOSING = '{"doc_data":{', '},"index":[', ("]}", "]}]}")
ENDS = (f"{BETWEEN}\n{CLOSING[0]}", f"\n{CLOSING[1]}")


def _list_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of JSON from postings ``(term, value)`` in the order of terms, each of as many postings of a term as a batch
    has. One that goes on with a term names it in its first posting, besides what the format asks for."""
    last = None
    for b in batches:
        terms, values = b.columns
        if not len(terms):
            continue
        starts = np.append(0, np.flatnonzero(pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False)) + 1)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(terms)), pa.int32()), values), ",")
        named = terms.take(pa.array(starts)).to_pylist()
        heads = [']},{"term":' + json.dumps(t) + ',"posting_list":[' for t in named]
        if named[0] == last:
            first = values[0].as_py()
            heads[0] = "," + first[:-1] + ',"term":' + json.dumps(last) + "}"
            joined = pa.concat_arrays([pa.array([joined[0].as_py()[len(first) :]]), joined[1:]])
        last = named[-1]
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(pa.array(heads), joined, "")], ["value"])


def export_json(index: SearchIndex, path: str) -> None:
    """Write the index to one JSON file, in one step: the lines of documents and lists are
    made by tasks and put one after the other into the file, by the driver but not through
    its memory. For exchange; the native store is the smaller one."""
    spark = index.postings.sparkSession
    check_json_path(path)
    with scope(spark):
        index = index.stored()
        docs = index.doc_stats.orderBy("doc_id").select(F.concat(F.lit(',"'), F.col("doc_id").cast("string"), F.lit('":'), F.to_json(F.struct("slug", "num_terms"))).alias("value"))
        # by ranges of terms, so that a list lies in one task, which sorts and writes it row by row
        sorted_ = index.postings.select("term", "doc_id", "positions").repartitionByRange("term").sortWithinPartitions("term", "doc_id")
        lists = sorted_.select("term", F.to_json(F.struct("doc_id", F.col("positions").alias("postings"))).alias("value")).mapInArrow(_list_lines, "value string")
        _put_lines(spark, path, [(OPENING, ",", docs), (BETWEEN, "]},", lists)], CLOSING)


def _put_lines(spark: SparkSession, path: str, tables: list[tuple[str, str, DataFrame]], closing: tuple[str, str]) -> None:
    """Replace a file in one step by a line for each table and the table's lines, of which the first
    loses what separates it from others; closed by the one if the last table is empty, else by the other."""
    jvm = spark.sparkContext._jvm
    fs, target = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    for opening, between, lines in tables:
        at = fresh_path(spark)
        lines.write.option("lineSep", "\n").text(at)
        folder_fs, folder = _fs(spark, at)
        files = sorted((s for s in folder_fs.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s.getPath().getName())
        out.write(bytearray(f"{opening}\n".encode()))
        for i, file in enumerate(files):
            stream = folder_fs.open(file.getPath())
            if not i:
                stream.seek(len(between))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, PIECE, False)
            stream.close()
        folder_fs.delete(folder, True)
    out.write(bytearray(closing[bool(files)].encode()))
    out.close()
    _replace(fs, part, target)


def _in_lines(spark: SparkSession, path: str) -> bool:
    """Whether ``export_json`` wrote this file, to its end."""
    fs, target = _fs(spark, path)
    size = fs.getFileStatus(target).getLen()
    stream = fs.open(target)
    begin = bytes(stream.readNBytes(len(OPENING) + 1)).decode(errors="replace")
    stream.seek(max(0, size - max(map(len, ENDS))))
    end = bytes(stream.readAllBytes()).decode(errors="replace")
    stream.close()
    return begin == f"{OPENING}\n" and end.endswith(ENDS)


def _from_lines(lines: DataFrame, analyzer: Analyzer | None) -> SearchIndex:
    """An index from the lines of such a file, which tasks read side by side."""
    line, strict = F.col("value"), {"mode": "FAILFAST"}
    lines = lines.where(~line.isin(OPENING, BETWEEN, *CLOSING))
    of_document = line.startswith('"') | line.startswith(',"')
    parsed = lines.where(of_document).select(F.explode(F.from_json(F.concat(F.lit("{"), F.ltrim(line, F.lit(",")), F.lit("}")), "map<string,struct<slug:string,num_terms:bigint>>", strict)).alias("k", "d"))
    docs = durable(parsed.select(F.col("k").cast("bigint").alias("doc_id"), "d.slug", "d.num_terms"))
    rest = F.when(line.startswith("]},"), F.substring(line, F.lit(4), F.length(line))).when(line.startswith(","), F.substring(line, F.lit(2), F.length(line))).otherwise(line)
    whole = F.concat(F.when(rest.startswith('{"term":'), "").otherwise('{"posting_list":['), rest, F.lit("]}"))
    lists = lines.where(~of_document).select(F.from_json(whole, "term string, posting_list array<struct<doc_id:bigint,postings:array<int>,term:string>>", strict).alias("l"))
    term = F.coalesce("l.term", F.get("l.posting_list", F.lit(0))["term"], F.raise_error(F.lit("a line of the index has no term")))
    # the term goes into each posting, lest each row made of a list be given the whole list to find it
    flat = lists.select(F.inline(F.transform("l.posting_list", lambda p: F.struct(term.alias("term"), p["doc_id"].alias("doc_id"), p["postings"].alias("positions")))))
    lengths = docs.select("doc_id", F.col("num_terms").alias("dl"))
    postings = flat.join(F.broadcast(lengths) if lengths.count() <= FEW else lengths, "doc_id").select("term", "doc_id", F.size("positions").cast("bigint").alias("tf"), "dl", "positions")
    return SearchIndex(postings, docs, analyzer or Analyzer())


def from_json(document: DataFrame, analyzer: Analyzer | None = None) -> SearchIndex:
    """An index from rows of ``doc_data`` and ``index`` in the exchange schema."""
    docs = document.select(F.explode("doc_data").alias("k", "d")).select(F.col("k").cast("bigint").alias("doc_id"), "d.slug", "d.num_terms")
    lists = document.select(F.inline("index")).select("term", F.inline("posting_list"))
    flat = lists.select("term", "doc_id", F.size("postings").cast("bigint").alias("tf"), F.col("postings").alias("positions"))
    postings = flat.join(docs.select("doc_id", F.col("num_terms").alias("dl")), "doc_id").select("term", "doc_id", "tf", "dl", "positions")
    return SearchIndex(postings, docs, analyzer or Analyzer())


def import_json(spark: SparkSession, path: str, analyzer: Analyzer | None = None) -> SearchIndex:
    """An index from a JSON file; an empty one if the file is missing. One that ``export_json``
    wrote is read by lines; another is one record, which one task reads and holds."""
    fs, target = _fs(spark, check_json_path(path))
    if not fs.exists(target):
        return empty_index(spark, analyzer)
    if _in_lines(spark, path):
        return _from_lines(spark.read.option("lineSep", "\n").text(path), analyzer)
    return from_json(spark.read.schema(JSON_INDEX).option("multiLine", True).option("mode", "FAILFAST").json(path), analyzer)


__all__ = ["DOC_STATS", "POSTINGS", "AnalyzerMismatch", "check_json_path", "export_json", "from_json", "import_json", "lists_from_json", "lists_to_json", "load", "save", "vacuum"]
