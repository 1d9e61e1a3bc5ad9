"""Template residue and error pages over a whole corpus: pages aligned by template, slots judged, verdicts joined back.

1. Each text that has no content of its own is reduced to its template: what shows its kind, with all that varies
   masked. Pages are counted by template, the template is judged once from what its pages show, and every page has
   the verdict of its template. Signs that need no language (a status code as a title, scripts named) count only for
   a template that is repeated.
2. All other texts are aligned with those that share a signature of their frame: places that vary are slots, and a
   text whose slots keep names of variables, defaults or blanks was never filled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.alignment import SIBLINGS, Frame, open_template, places
from cairn.llm.residue import is_source, page
from cairn.runtime import arrow_map, cut, join_counted, small, spread

_PAGE = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("hint", pa.string()), ("slots", pa.int64()), ("words", pa.int64()), ("template", pa.string()), ("open", pa.bool_()), ("signatures", pa.list_(pa.int64()))])
_PLACE = pa.schema([("signature", pa.int64()), ("place", pa.int64()), ("value", pa.string())])
_OPEN = pa.schema([("doc_id", pa.int64()), ("slots", pa.int64())])

#: A template that has this many pages is repeated: it speaks for those of its pages that show nothing by themselves.
TEMPLATE_PAGES = 4


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(schema), schema)], schema=schema)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, lang, path in zip(*(batch.column(k).to_pylist() for k in range(4))):
            p = page(text, lang, path)
            judged = (p.kind, p.hint, p.slots, p.words, p.template) if p is not None else (None,) * 5
            frame = Frame(text)
            # A page that shows its kind by itself needs no siblings, but may be one.
            opened = not (p is not None and p.kind) and not is_source(text, lang, path) and frame.may_be_open()
            rows.append((doc, *judged, opened, list(frame.signatures())))
        yield _batch(rows, _PAGE)


def _rows(documents: DataFrame) -> DataFrame:
    columns = [F.col(c) if c in documents.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "rel_path")]
    return documents.select(F.col("doc_id").cast("long"), "text", *columns).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())


def scanned(documents: DataFrame) -> DataFrame:
    """doc_id, kind, hint, slots, words, template, open, signatures of each document; those with content of their own have no kind.

    open: whether it shows what slots hold that were never filled. signatures: those of its frame, to find its siblings.
    documents: doc_id, text, and lang and rel_path if there; other columns are ignored. Null ids and texts are left out.
    """
    return arrow_map(spread(_rows(documents)), _pages, "doc_id bigint, kind string, hint string, slots bigint, words bigint, template string, open boolean, signatures array<bigint>")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at = places(text)
            rows += [(s, k, value) for s in wanted for k, (_, value) in enumerate(at.get(s, []))]
        yield _batch(rows, _PLACE)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, lang, path, signature, varying in zip(*(batch.column(k).to_pylist() for k in range(6))):
            slots = open_template(text, signature, {v["place"]: (v["low"], v["high"]) for v in varying}, lang, path)
            if slots:
                rows.append((doc, slots))
        yield _batch(rows, _OPEN)


def open_templates(documents: DataFrame, seen: DataFrame) -> DataFrame:
    """doc_id, slots of the documents that, held against their siblings, are templates with slots that were never filled.

    seen: scanned(documents), cut. Only families of siblings with an open document are aligned. Of each place the
    least and greatest value are taken, combined before the shuffle, so a template with very many pages isn't one task.
    Repeated rows change neither; a document's verdicts are counted once.
    """
    member = seen.select("doc_id", "open", F.explode("signatures").alias("signature")).distinct()
    families = member.groupBy("signature").agg(F.count("*").alias("n"), F.max("open").alias("any_open")).where((F.col("n") >= SIBLINGS) & F.col("any_open"))
    member = cut(member.join(small(families.select("signature")), "signature"))
    texts = _rows(documents)
    siblings = texts.select("doc_id", "text").join(small(cut(member.groupBy("doc_id").agg(F.collect_set("signature").alias("wanted")))), "doc_id").select("text", "wanted")
    at = arrow_map(siblings, _places, "signature bigint, place bigint, value string")
    ends = at.groupBy("signature", "place").agg(F.min("value").alias("low"), F.max("value").alias("high")).where("low < high")
    slots = ends.groupBy("signature").agg(F.collect_list(F.struct("place", "low", "high")).alias("varying"))
    candidates = texts.join(small(member.where("open").select("doc_id", "signature")), "doc_id").join(slots, "signature")
    judged = arrow_map(candidates.select("doc_id", "text", "lang", "rel_path", "signature", "varying"), _judged, "doc_id bigint, slots bigint")
    return judged.groupBy("doc_id").agg(F.max("slots").alias("slots"))


def templates(found: DataFrame) -> DataFrame:
    """template, pages, kind: each template of pages with the kind that most of its pages show, '' if they show none.

    Most is more than half of them; a template that is repeated may also be known by more than half of its hints.
    """
    by_kind = found.groupBy("template", "kind", "hint").agg(F.count("*").alias("n"))
    most = lambda c: F.max_by(F.struct(c, "n"), F.struct((F.col(c) != "").cast("int"), "n", c))
    kinds, hints = by_kind.groupBy("template", "kind").agg(F.sum("n").alias("n")), by_kind.groupBy("template", "hint").agg(F.sum("n").alias("n"))
    by = kinds.groupBy("template").agg(F.sum("n").alias("pages"), most("kind").alias("k"))
    hinted = hints.groupBy(F.col("template").alias("_t")).agg(most("hint").alias("h"))
    both = by.join(hinted, F.col("template") == F.col("_t"))
    verdict = F.when(F.col("k.n") * 2 > F.col("pages"), F.col("k.kind")).otherwise(F.lit(""))
    by_hint = F.when((F.col("pages") >= TEMPLATE_PAGES) & (F.col("h.n") * 2 > F.col("pages")), F.col("h.hint")).otherwise(F.lit(""))
    return both.select("template", "pages", F.when(verdict != "", verdict).otherwise(by_hint).alias("kind"))


def residue(documents: DataFrame) -> DataFrame:
    """doc_id, kind, evidence of the documents without content of their own: template, filler, error or script.

    Empty and very short texts, template sources, and texts that quote or handle such things aren't among them.
    evidence: repeated (its template has TEMPLATE_PAGES pages or more), single (the template of fewer pages shows its
    kind), slots (held against its siblings it has slots that were never filled). Where the pages of a template
    disagree, what a page shows by itself counts.
    """
    seen = cut(scanned(documents))
    found = cut(seen.where("kind IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("kind", "hint", "template")).alias("p")).select("doc_id", "p.*"))
    judged = cut(templates(found)).withColumnsRenamed({"kind": "by_template"})
    placed = join_counted(found, judged.withColumn("n", F.col("pages")), ["template"], "n")
    kind = F.when((F.col("pages") < TEMPLATE_PAGES) & (F.col("kind") != ""), F.col("kind")).when(F.col("by_template") != "", F.col("by_template")).otherwise(F.col("kind"))
    alone = placed.select("doc_id", kind.alias("kind"), F.when(F.col("pages") >= TEMPLATE_PAGES, "repeated").otherwise("single").alias("evidence")).where("kind <> ''")
    aligned = open_templates(documents, seen).select("doc_id", F.lit("template").alias("kind"), F.lit("slots").alias("evidence"))
    # What a template shows comes first; alignment adds those that show it only beside their siblings.
    both = alone.withColumn("by", F.lit(0)).unionByName(aligned.withColumn("by", F.lit(1)))
    return both.groupBy("doc_id").agg(F.min_by(F.struct("kind", "evidence"), "by").alias("v")).select("doc_id", "v.*")
