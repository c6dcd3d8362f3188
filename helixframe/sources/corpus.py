"""Readers of the corpus and its reports.

Every reader returns a frame with an explicit schema; positions in lists become
columns, because other files refer to records by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions import codons as C
from helixframe.session import spread

RECORD = (
    "id string, gene_name string, species string, sequence string, protein_sequence string, "
    "codon_tokens array<int>, protein_tokens array<int>, is_augmented boolean, source_id string"
)
NEIGHBOUR = "struct<rank:int,train_idx:bigint,species:string,edit_distance:int,identity:double,identity_over_query:double,identity_over_max:double>"


def records_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of a document {codon_vocab, aa_vocab, records: [...]}, with its position idx."""
    doc = spark.read.schema(f"records array<struct<{RECORD.replace(' ', ':', 1).replace(', ', ',').replace(' string', ':string').replace(' array', ':array').replace(' boolean', ':boolean')}>>").json(path, multiLine=True)
    return doc.select(F.posexplode("records").alias("idx", "r")).select(F.col("idx").cast("long").alias("idx"), "r.*")


def split_json(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(split, pos, idx) of a file {indices: [...]}; the order of the list is kept."""
    doc = spark.read.schema("indices array<bigint>").json(path, multiLine=True)
    return doc.select(F.lit(name).alias("split"), F.posexplode("indices").alias("pos", "idx"))


def organism_csv(spark: SparkSession, path: str, organisms: list[str]) -> DataFrame:
    """organism, protein and dna of wanted organisms, where the DNA has a codon for each residue and a stop.

    Columns are found by the header's names, in whatever order they stand.
    """
    rows = spark.read.csv(path, header=True, inferSchema=False, maxCharsPerColumn=-1).select("organism", "protein", F.upper("dna").alias("dna"))
    rows = rows.where(F.col("organism").isin(organisms)).withColumn("protein", C.strip_stops(F.col("protein"), "_"))
    return rows.where((F.length("protein") > 0) & (F.length("dna") == 3 * (F.length("protein") + 1)))


def keyed_report(spark: SparkSession, path: str, field: str, value: str) -> DataFrame:
    """(idx, value) of a map keyed by record positions in text form."""
    doc = spark.read.schema(f"{field} map<string,{value}>").json(path, multiLine=True)
    return doc.select(F.explode(field).alias("key", "value")).select(F.col("key").cast("long").alias("idx"), "value")


def retrieval_report(spark: SparkSession, path: str) -> DataFrame:
    fields = "idx:bigint,gene:string,species:string,protein_len:int,max_identity_to_train:double,max_identity_over_query:double,neighbor_species:string,copied_fraction:double,len_ok:boolean,bleu_homology_copy:double,homology_copy_sequence:string"
    return spark.read.schema(f"per_sequence array<struct<{fields},neighbors:array<{NEIGHBOUR}>>>").json(path, multiLine=True).selectExpr("inline(per_sequence)")


MEASURES = ("mt_cai", "codon_diversity", "bleu", "mfe", "gc_content", "is_novel", "mfe_delta_from_natural", "gc_delta_from_natural")


def raw_results(spark: SparkSession, path: str) -> DataFrame:
    """(method, pos, metric, value) of a report with lists of measures by method; NaN is null, code_compliant 1 or 0."""
    row = ", ".join([*(f"{m}: double" for m in MEASURES), "code_compliant: boolean"])
    doc = spark.read.schema(f"raw_results map<string, array<struct<{row}>>>").json(path, multiLine=True)
    rows = doc.select(F.explode("raw_results").alias("method", "rows")).select("method", F.posexplode("rows").alias("pos", "m"))
    values = {m: F.nanvl(f"m.{m}", F.lit(None).cast("double")) for m in MEASURES} | {"code_compliant": F.col("m.code_compliant").cast("int").cast("double")}
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()])
    return rows.select("method", "pos", F.inline(pairs)).where("value is not null")


def runs(spark: SparkSession, glob: str) -> DataFrame:
    """Training histories of run folders, with tag and seed read off the path."""
    rows = spark.read.json(glob, multiLine=True).withColumn("path", F.col("_metadata.file_path"))
    return rows.withColumn("seed", F.regexp_extract("path", r"_s(\d+)/", 1).try_cast("int")).withColumn("tag", F.regexp_extract("path", r"\d{8}_\d{6}_?([^/]*?)(?:_s\d+)?/", 1))


def numbered_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, line_no, line) of the lines of text files that match."""
    text = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    lines = text.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return lines.withColumn("line_no", F.col("line_no") + 1).where(F.col("line").rlike(pattern))


def survey_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("papers array<struct<short:string,venue:string,baselines:array<string>,homology_baseline:boolean>>").json(path, multiLine=True).selectExpr("inline(papers)")


def optional(read, path: str) -> DataFrame | None:
    """read(path), or None where there is nothing to read."""
    from pyspark.errors import AnalysisException

    try:
        return read(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def preferred(standalone: DataFrame | None, embedded: DataFrame | None) -> DataFrame | None:
    """The standalone source where there is one, else the embedded one."""
    return standalone if standalone is not None else embedded


def run_status(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each run folder below folder: epochs, best epoch, status and the last line of its log.

    A run is complete once it has its configured epochs, or once the best loss
    has stood for more than the configured patience.
    """
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/(?:logs/)?[^/]+$", 1)
    epoch = "epoch int, val_loss double"
    history = optional(lambda p: spark.read.schema(epoch).json(p, multiLine=True).select(name.alias("run"), "epoch", "val_loss"), f"{folder}/*/metrics.json")
    config = optional(lambda p: spark.read.schema("training struct<epochs: int, early_stopping_patience: int>").json(p, multiLine=True).select(name.alias("run"), "training.*"), f"{folder}/*/config.json")
    logs = optional(lambda p: spark.read.text(p, wholetext=True).select(name.alias("run"), "value"), f"{folder}/*/logs/train.log")
    history = history if history is not None else spark.createDataFrame([], f"run string, {epoch}")
    config = config if config is not None else spark.createDataFrame([], "run string, epochs int, early_stopping_patience int")
    logs = logs if logs is not None else spark.createDataFrame([], "run string, value string")
    best = F.min(F.struct("val_loss", "epoch"))
    seen = history.groupBy("run").agg(F.count("*").alias("epochs_completed"), best.alias("best"), F.max("epoch").alias("last"))
    lines = logs.select("run", F.trim(F.element_at(F.split(F.regexp_replace("value", r"\s+$", ""), "\n"), -1)).alias("latest_log_line"))
    out = seen.join(config, "run", "full").join(lines, "run", "full").withColumn("epochs_completed", F.coalesce("epochs_completed", F.lit(0)))
    stood = F.col("last") - F.col("best.epoch")
    patience = F.col("early_stopping_patience")
    done = F.coalesce(F.col("epochs_completed") >= F.col("epochs"), F.lit(False)) | F.coalesce((patience > 0) & (F.col("epochs_completed") > patience) & (stood >= patience), F.lit(False))
    status = F.when(done & F.col("epochs").isNotNull(), "complete").when(F.col("epochs_completed") > 0, "training").otherwise("starting")
    return out.select("run", "epochs_completed", F.col("epochs").alias("configured_epochs"), status.alias("status"), F.col("best.val_loss").alias("best_val_loss"), F.col("best.epoch").alias("best_epoch"), F.coalesce("latest_log_line", F.lit("")).alias("latest_log_line"))


def pending_files(spark: SparkSession, glob: str, idle_seconds: int) -> DataFrame:
    """(path, idle) of files that nobody has changed for so many seconds."""
    files = spark.read.format("binaryFile").load(glob).select("path", (F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("modificationTime")).alias("idle"))
    return files.where(F.col("idle") >= idle_seconds)


ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: Letters of a derived record.
PIECE = 300
#: Letters that are cut into records together, at least one text.
LETTERS = 1 << 21

# Codons by number, 16 * first + 4 * second + third in the order of the translation tables.
_CODONS = np.array([np.frombuffer(f"{a}{b}{c}".encode(), np.uint8) for a in C.BASES for b in C.BASES for c in C.BASES])
_RESIDUES = np.frombuffer(C.TABLES[2].encode(), np.uint8)
_NUMBER = {bytes(c).decode(): k for k, c in enumerate(_CODONS)}
#: A codon's number with stops given way to TTA, and the bases of the letters a to z.
_CODING = np.array([_NUMBER["TTA"] if bytes(c).decode() in C.STOPS else k for k, c in enumerate(_CODONS)])
_BASE = np.zeros(256, np.int64)
_BASE[[ord(x) for x in ALPHABET]] = [C.BASES.index(x) for x in ("ACGT" * 7)[:26]]
#: Bytes of a text that are small letters once it is in lower case, as these; 0 for all others.
_SMALL = np.zeros(256, np.uint8)
_SMALL[[ord(x) for x in ALPHABET]] = _SMALL[[ord(x) for x in ALPHABET.upper()]] = [ord(x) for x in ALPHABET]
#: The two letters outside ASCII whose lower case has one within: both are longer than it, so that it takes the place of the first byte.
_FOREIGN = (("\u0130".encode(), b"i"), ("\u212a".encode(), b"k"))


def _letters(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(small letters, where each text's end) of texts in UTF-8 that lie side by side."""
    found = _SMALL[data]
    high = np.flatnonzero(data > 0xC3)
    for letter, small in _FOREIGN if len(high) else ():
        at = high[data[high] == letter[0]]
        for k in range(1, len(letter)):
            at = at[at + k < len(data)]
            at = at[data[at + k] == letter[k]]
        found[at] = small[0]
    kept = np.flatnonzero(found)
    return found[kept], np.searchsorted(kept, ends)


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _cut(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, columns: tuple[str, ...]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(text of each piece, columns of the pieces) of texts of small letters that begin at starts, each of three letters or more."""
    made = {}
    pieces = (sizes - 3) // PIECE + 1
    text = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = starts[text] + piece * PIECE
    size = np.minimum(PIECE, sizes[text] - piece * PIECE)
    if "piece" in columns:
        made["piece"] = pa.array(piece.astype(np.int32))
    if "gene" in columns:
        weight = sum(k * np.where(size >= at, letters[np.minimum(first + at - 1, len(letters) - 1)].astype(np.int64) - 97, 0) for k, at in ((1, 1), (3, 3), (7, 6)))
        made["gene"] = pa.array((weight % len(C.GENES)).astype(np.int32))
    if "sequence" not in columns and "protein_sequence" not in columns:
        return text, made
    codons = size // 3
    owner = np.repeat(np.arange(len(text)), codons)
    at = np.repeat(first - 3 * (np.cumsum(codons) - codons), codons) + 3 * np.arange(len(owner))
    base = _BASE[letters]
    number = _CODING[16 * base[at] + 4 * base[at + 1] + base[at + 2]]
    # Each record's codons, and TAA behind them.
    whole = np.full(len(owner) + len(text), _NUMBER["TAA"])
    whole[np.arange(len(owner)) + owner] = number
    if "sequence" in columns:
        made["sequence"] = _strings(_CODONS[whole].ravel(), 3 * (codons + 1))
    if "protein_sequence" in columns:
        made["protein_sequence"] = _strings(_RESIDUES[whole], codons + 1)
    return text, made


def _pieces(keep: list[str], columns: tuple[str, ...]):
    """The pieces of texts' letters, as records: many texts at once, none of their copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            if not len(texts):
                continue
            _, ends, data = texts.buffers()
            ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + LETTERS, "right")) - 1)
                letters, cuts = _letters(data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
                sizes = np.diff(cuts)
                some = np.flatnonzero(sizes >= 3)
                if len(some):
                    text, made = _cut(letters, cuts[:-1][some], sizes[some], columns)
                    kept = {c: batch.column(c).take(pa.array(lo + some[text])) for c in keep}
                    yield pa.RecordBatch.from_pydict({**kept, **made})
                lo = hi

    return run


#: What a record's columns are made of: columns of the text, and of the piece.
_MADE_OF = {
    "idx": ("doc_id", "piece"), "id": ("doc_id", "piece"), "gene_name": ("gene",), "species": ("lang", "source"),
    "sequence": ("sequence",), "protein_sequence": ("protein_sequence",), "split": ("doc_id",),
}
_PIECE = "piece int, gene int, sequence string, protein_sequence string"


def derived_records(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = tuple(_MADE_OF), split: str | None = None) -> DataFrame:
    """Stand-in records from the documents table: letters mapped to bases, no biological meaning.

    The letters of a text are cut into pieces of 300, each of which is a record;
    together they hold all codons of the text. One or two letters at the end that
    make no codon are left; texts of fewer than three letters have no record. Of
    the columns only those asked for are made, and only the records of a split.
    """
    which = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "val").otherwise("train")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    docs = spread((docs.where(which == split) if split else docs).select("doc_id", "lang", "source", "text"))
    used = {x for c in columns for x in _MADE_OF[c]}
    keep = [c for c in ("doc_id", "lang", "source") if c in used]
    # Rows are told by one column at least.
    made_of = [f for f in T.StructType.fromDDL(_PIECE) if f.name in used or not used.difference(keep) and f.name == "piece"]
    schema = T.StructType([*(docs.schema[c] for c in keep), *made_of])
    made = docs.select(*keep, "text").mapInArrow(_pieces(keep, tuple(f.name for f in made_of)), schema)
    record = {
        "idx": F.col("doc_id") * 10_000_000 + F.col("piece"),
        "id": F.concat(F.lit("REC"), F.col("doc_id"), F.lit("_"), F.col("piece")),
        "gene_name": F.element_at(F.array(*[F.lit(g) for g in C.GENES]), F.col("gene") + 1),
        "species": F.concat_ws("_", "lang", "source"),
        "sequence": F.col("sequence"),
        "protein_sequence": F.col("protein_sequence"),
        "split": which,
    }
    return made.select(*[record[c].alias(c) for c in columns])
