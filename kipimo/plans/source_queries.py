"""Registered queries: sources, sinks and the file stream.

Each writes derived tables below the session's shared folder and reads them back
through the library's readers.
"""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import containment, tables
from ..operators import speech as S
from ..sources import readers, writers
from ..sources.clip_files import local_path
from ..streaming.scoring import score_stream as run_stream
from ..streaming.scoring import score_utterance_rows
from . import views
from .clip_queries import frame_sums
from .oracle import resampled, with_ctes
from .registry import query
from .speech_queries import _BY_MODEL, KEYS, asr_by_model, scored
from .stage import scratch_path

LANDED_ROWS = 200_000
# The fastest level: a fifth of the plain size, for hardly more time than writing it.
_LANDED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": LANDED_ROWS}


@query(
    "read_pairs",
    with_ctes(
        """SELECT id, category, text_a, text_b, CASE WHEN category IN ('paraphrase', 'informal', 'code_switching')
          THEN 'similar' ELSE 'other' END AS expected_relation FROM pairs""",
        "pairs",
    ),
)
def read_pairs(spark, sf_dir):
    path = scratch_path(spark, "pairs")
    expected = F.when(
        F.col("category").isin("paraphrase", "informal", "code_switching"), "similar"
    ).otherwise("other")
    manifest = views.scored_pairs(spark, sf_dir).select(
        "id", "category", "text_a", "text_b", expected.alias("expected_relation")
    )
    manifest.write.json(path)
    return readers.read_pairs(spark, path, multi_line=False)


@query(
    "read_speech_manifest",
    with_ctes(
        """SELECT doc_id || '_' || seg AS id, category, 'audio/' || doc_id || '_' || seg || '.wav' AS audio,
          array_to_string(r, ' ') AS reference FROM segments""",
        "segments",
    ),
)
def read_speech_manifest(spark, sf_dir):
    path = scratch_path(spark, "speech")
    name = F.concat_ws("_", "doc_id", "seg")
    views.segments(spark, sf_dir).select(
        name.alias("id"),
        "category",
        F.concat(F.lit("audio/"), name, F.lit(".wav")).alias("audio"),
        F.array_join("words", " ").alias("reference"),
    ).write.json(path)
    return readers.read_speech_manifest(spark, path, multi_line=False)


@query(
    "read_result_records",
    with_ctes(
        """SELECT id, category, text_a, text_b, sim_a AS similarity_a, sim_b AS similarity_b, ms_a + ms_b AS total_ms
        FROM pairs""",
        "pairs",
    ),
)
def read_result_records(spark, sf_dir):
    path = scratch_path(spark, "records")
    record = F.struct("id", "category", "text_a", "text_b", "models")
    views.scored_pairs(spark, sf_dir).select(F.array(record).alias("records")).write.json(path)
    records = readers.read_result_records(spark, path, multi_line=False)
    a, b = (F.col("models")[m] for m in views.ENCODERS)
    return records.select(
        "id",
        "category",
        "text_a",
        "text_b",
        a["similarity"].alias("similarity_a"),
        b["similarity"].alias("similarity_b"),
        (a["inference_time_ms"] + b["inference_time_ms"]).alias("total_ms"),
    )


@query(
    "read_clips",
    with_ctes(
        """SELECT CASE WHEN clip_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, 'c' || clip_id % 4 AS label,
          'clip_' || lpad(clip_id::VARCHAR, 12, '0') || '.npy' AS file, i AS k, round(sum(v), 5) AS total,
          round(sum(v * (d + 1)), 4) AS weighted FROM source GROUP BY clip_id, i""",
        "source",
    ),
)
def read_clips(spark, sf_dir):
    """Clips written as a tree of ``.npy`` files and read from it."""
    path = scratch_path(spark, "clips")
    writers.write_clip_files(views.source_clips(spark, sf_dir).select("split", "label", "file", "frames"), path)
    clips = readers.read_clips(spark, path, width=views.LAYOUT.source_width)
    return frame_sums(clips.filter("reason is null"), keys=("split", "label", "file"))


_HELD_OUT = "src0"


@query(
    "exclude_leaked",
    f"""SELECT doc_id FROM documents d WHERE source IS DISTINCT FROM '{_HELD_OUT}'
      AND NOT EXISTS (SELECT 1 FROM documents h WHERE h.source = '{_HELD_OUT}' AND h.text = d.text)""",
)
def exclude_leaked(spark, sf_dir):
    """Documents of the other sources whose text is not also in the held-out source."""
    rest, held_out = _by_source(spark, sf_dir)
    return tables.exclude_leaked(rest, held_out, "text").select("doc_id")


@query(
    "leaked_counts",
    f"""SELECT count(*) AS rows, count(*) FILTER (WHERE leaked) AS leaked_rows,
      count(DISTINCT text) FILTER (WHERE leaked) AS leaked_contents
    FROM (SELECT text, text IN (SELECT text FROM documents WHERE source = '{_HELD_OUT}') AS leaked
      FROM documents WHERE source IS DISTINCT FROM '{_HELD_OUT}')""",
)
def leaked_counts(spark, sf_dir):
    return tables.leaked_counts(*_by_source(spark, sf_dir), "text")


def _by_source(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents")
    held_out = F.col("source").eqNullSafe(_HELD_OUT)
    return documents.filter(~held_out), documents.filter(held_out)


def _spaced(table: str, key: str) -> str:
    """Word sequences, each word between single spaces."""
    words = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
    return f"SELECT {key}, ' ' || array_to_string({words}, ' ') || ' ' AS s FROM {table} WHERE len({words}) > 0"


_CONTAINED = f"""WITH d AS ({_spaced("documents", "doc_id")}),
  i AS (SELECT min(item_id) AS item_id, s, count(*) AS copies FROM ({_spaced("benchmark", "item_id")}) GROUP BY s),
  found AS (SELECT doc_id, item_id, copies FROM d JOIN i ON contains(d.s, i.s))"""


@query("contained_texts", f"{_CONTAINED} SELECT DISTINCT * FROM found")
def contained_texts(spark, sf_dir):
    """Documents and the benchmark texts that they hold word for word."""
    documents, benchmark = (views.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return containment.contained_texts(documents, benchmark).drop("doc_key")


@query("exclude_containing", f"{_CONTAINED} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM found)")
def exclude_containing(spark, sf_dir):
    documents, benchmark = (views.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return containment.exclude_containing(documents, benchmark).select("doc_id")


@query(
    "held_out_inside",
    f"""WITH d AS ({_spaced("(SELECT * FROM documents WHERE source IS DISTINCT FROM '" + _HELD_OUT + "')", "doc_id")}),
      i AS (SELECT min(doc_id) AS item_id, s, count(*) AS copies
        FROM ({_spaced("(SELECT * FROM documents WHERE source = '" + _HELD_OUT + "')", "doc_id")}) GROUP BY s)
    SELECT DISTINCT doc_id, item_id, copies FROM d JOIN i ON contains(d.s, i.s)""",
)
def held_out_inside(spark, sf_dir):
    """Documents of the other sources that hold a whole document of the held-out one."""
    rest, held_out = _by_source(spark, sf_dir)
    return containment.contained_texts(rest, held_out, item_id="doc_id").drop("doc_key")


@query(
    "list_assets",
    """SELECT '/media/' || source || '/' || doc_id || ['.mp4', '.MOV', '.m4v', '.Avi', '.txt', ''][doc_id % 6 + 1] AS path,
      n_chars AS length, ['mp4', 'mov', 'm4v', 'avi'][doc_id % 6 + 1] AS suffix FROM documents WHERE doc_id % 6 < 4""",
)
def list_assets(spark, sf_dir):
    """A tree of mixed files, as long as the documents; only those with media suffixes are listed."""
    ending = F.get(
        F.array(*[F.lit(x) for x in (".mp4", ".MOV", ".m4v", ".Avi", ".txt", "")]),
        (F.col("doc_id") % 6).cast("int"),
    )
    root = local_path(scratch_path(spark, "media"))
    name = F.concat(F.lit("media/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ending)
    files = views.table(spark, sf_dir, "documents").select(name.alias("path"), F.col("n_chars").alias("length"))

    def made(batches):
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"]):
                os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
                with open(f"{root}/{path}", "wb") as file:
                    file.truncate(int(length))  # a file of holes
            yield batch[[]].assign(n=1)

    files.mapInPandas(made, "n long").write.format("noop").mode("overwrite").save()
    listed = readers.list_assets(spark, root)
    return listed.withColumn("path", F.substring("path", len(root) + 1, 1 << 20))


@query("write_report", with_ctes(_BY_MODEL, "scored_utt"))
def write_report(spark, sf_dir):
    """The nested report: header fields and a list of models, read back and unfolded."""
    path = scratch_path(spark, "report")
    report = asr_by_model(spark, sf_dir)
    writers.write_nested_report({"experiment": "speech", "digits": 6}, {"models": report}, path)
    schema = T.StructType(
        [
            T.StructField("experiment", T.StringType()),
            T.StructField("digits", T.IntegerType()),
            T.StructField("models", T.ArrayType(report.schema)),
        ]
    )
    whole = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select(F.inline("models"))


@query(
    "write_csv",
    with_ctes(
        """SELECT doc_id, seg, category, model, round(wer, 6) AS wer, round(cer, 6) AS cer, reference FROM scored_utt""",
        "scored_utt",
    ),
)
def write_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rows = scored(spark, sf_dir).select(
        *KEYS,
        "category",
        "model",
        F.round("wer", 6).alias("wer"),
        F.round("cer", 6).alias("cer"),
        "reference",
    )
    writers.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


@query(
    "write_clips",
    with_ctes(
        """SELECT 'c' || clip_id % 4 AS label, 'clip_' || lpad(clip_id::VARCHAR, 12, '0') || '_64x63.npy' AS file, k,
          round(sum(v), 5) AS total, round(sum(v * (d + 1)), 4) AS weighted FROM result GROUP BY clip_id, k""",
        "steps",
        "native",
        result=resampled("native"),
    ),
)
def write_clips(spark, sf_dir):
    from ..functions.clips import interpolate_linear

    path = scratch_path(spark, "clips")
    clips = views.native_clips(spark, sf_dir)
    writers.write_clips(clips.withColumn("sequence", interpolate_linear(F.col("frames"))), path)
    return frame_sums(readers.read_clips(spark, path, width=views.LAYOUT.width), keys=("label", "file"))


@query(
    "score_stream",
    with_ctes(
        """SELECT doc_id || '_' || seg AS id, model, round(wer, 6) AS wer, round(cer, 6) AS cer FROM scored_utt""",
        "scored_utt",
    ),
)
def score_stream(spark, sf_dir):
    """Utterances land as JSON files, the stream scores them, the sink is read.

    Every text lands twice per model and the stream adds its normalised form: the files are
    compressed, and the sink holds the columns that are read.  A compressed file is one
    task's, so it ends at ``LANDED_ROWS`` rows.
    """
    folder = scratch_path(spark, "stream")
    kept = ["id", "model", "wer", "cer"]
    views.utterances(spark, sf_dir).select(
        F.concat_ws("_", *KEYS).alias("id"),
        "category",
        "model",
        F.col("reference").alias("reference_raw"),
        F.col("hypothesis").alias("hypothesis_raw"),
    ).write.options(**_LANDED).json(f"{folder}/in")
    run_stream(
        spark,
        f"{folder}/in",
        f"{folder}/out",
        f"{folder}/state",
        transform=lambda landed: score_utterance_rows(landed).select(*kept),
    )
    return spark.read.parquet(f"{folder}/out").select(*kept)


@query(
    "utterance_errors",
    with_ctes(
        """SELECT doc_id, seg, category, model, s AS substitutions, d AS deletions, i AS insertions,
          len(r) AS reference_words, round(wer, 6) AS wer, round(cer, 6) AS cer FROM aligned""",
        "aligned",
    ),
)
def utterance_errors(spark, sf_dir):
    """The flat error rows that go to the error CSV."""
    from .speech_queries import aligned_and_scored

    rows = S.utterance_errors(aligned_and_scored(spark, sf_dir), [*KEYS, "category"])
    counts = ("substitutions", "deletions", "insertions", "reference_words")
    return rows.select(
        *KEYS,
        "category",
        "model",
        *[F.col(c).cast("long").alias(c) for c in counts],
        *[F.round(c, 6).alias(c) for c in ("wer", "cer")],
    )
