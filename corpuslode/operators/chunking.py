"""Documents to chunks: sections under headers, sentences packed to a size, sentence windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslode.functions.values import strip
from corpuslode.operators.metadata import SECTION_TITLES, label_lines, truncate

# Sizes of section chunks and of sentence windows.
CHUNK_SIZE, OVERLAP, MIN_SECTION = 512, 50, 50
BASE_SIZE, BASE_OVERLAP, WINDOW = 1024, 20, 3
KEY_INFO_MISSING = "ข้อมูลสำคัญไม่พร้อมใช้งาน"
# Label of each part of the key information.
KEY_LABELS = {
    "deed_serial_no": "โฉนดเลขที่", "deed_type": "ประเภท", "location_hierarchy": "ที่ตั้ง", "coordinates_formatted": "พิกัด",
    "area_formatted": "เนื้อที่", "land_main_category": "หมวดหมู่",
}

def sentences(c: Column) -> Column:
    """The sentences of a text as column expressions."""
    parts = F.regexp_extract_all(c, F.lit(r"[^.!?。\n]*[.!?。\n]+|[^.!?。\n]+"), 0)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def packed(text: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """The chunks of ``packed_sentences`` as texts."""
    return F.transform(packed_sentences(text, size, overlap), lambda x: F.array_join(x, " "))


def packed_sentences(text: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """Chunks as arrays of their sentences: whole sentences up to ``size`` words; a chunk begins with the last sentences of the one before, ``overlap`` words at most.

    A fold over the row's own sentences: nothing is shuffled and no Python runs.
    A sentence over ``size`` words is a chunk of its own.
    """

    def pack(s: Column) -> Column:
        return _bound(F.transform(s, lambda x: F.regexp_count(x, F.lit(r"[^ \t\n\x0B\f\r]+"))), lambda w: cut(s, w))

    def cut(s: Column, w: Column) -> Column:
        def tail(start: Column, i: Column) -> Column:
            """How many of the sentences from ``start`` to before ``i`` begin the next chunk, and their words."""
            none = F.struct(F.lit(0).alias("c"), F.lit(0).alias("m"), F.lit(True).alias("open"))
            more = lambda t, x: t["open"] & (t["m"] + x <= overlap)
            step = lambda t, x: F.struct((t["c"] + F.when(more(t, x), 1).otherwise(0)).alias("c"), (t["m"] + F.when(more(t, x), x).otherwise(0)).alias("m"), more(t, x).alias("open"))
            return F.aggregate(F.reverse(F.slice(w, start + 1, i - start)), none, step)

        def step(state: Column, i: Column) -> Column:
            k = F.element_at(w, i + 1)
            full = (i > state["start"]) & (state["n"] + k > size)
            same = F.struct(state["start"].alias("start"), (state["n"] + k).alias("n"), state["out"].alias("out"))
            out = F.concat(state["out"], F.array(F.struct(state["start"].alias("a"), i.alias("b"))))

            def begin(t: Column) -> Column:
                fits = t["m"] + k <= size
                return F.struct(F.when(fits, i - t["c"]).otherwise(i).alias("start"), F.when(fits, t["m"] + k).otherwise(k).alias("n"), out.alias("out"))

            return F.when(full, _bound(tail(state["start"], i), begin)).otherwise(same)

        spans = F.expr("CAST(array() AS array<struct<a: int, b: int>>)")
        first = F.struct(F.lit(0).alias("start"), F.lit(0).alias("n"), spans.alias("out"))
        last = lambda state: F.concat(state["out"], F.array(F.struct(state["start"].alias("a"), F.size(s).alias("b"))))
        found = F.aggregate(F.sequence(F.lit(0), F.size(s) - 1), first, step, last)
        return F.when(F.size(s) > 0, F.transform(found, lambda x: F.slice(s, x["a"] + 1, x["b"] - x["a"]))).otherwise(F.expr("CAST(array() AS array<array<string>>)"))

    return _bound(sentences(text), pack)


def section_content(text: Column, title: str | Column) -> Column:
    """What stands between a header and the next ``##``; null without the header."""
    header = F.concat(F.lit("## "), F.lit(title) if isinstance(title, str) else title)
    at = F.position(header, text)
    after = F.substring_index(F.substring(text, at + F.length(header), F.lit(2**31 - 1)), "##", 1)
    return F.when(at > 0, strip(after))


def key_info(df: DataFrame) -> Column:
    """C2."""
    pairs = [(label, F.nullif(F.col(k).cast("string"), F.lit(""))) for k, label in KEY_LABELS.items() if k in df.columns]
    body = label_lines(pairs) if pairs else F.lit("")
    return F.when(body != "", body).otherwise(KEY_INFO_MISSING)


def section_chunks(
    docs: DataFrame, titles: dict[str, str] = SECTION_TITLES, size: int = CHUNK_SIZE, overlap: int = OVERLAP, least: int = MIN_SECTION, fallback: str = "full_document"
) -> DataFrame:
    """One row per chunk of each document (doc_id, text, metadata columns), built in the row: no shuffle, one scan.

    The key information is chunk 0. A section under ``least`` characters is
    dropped, one over 2 * ``size`` is split by sentences, each part under the
    section's title. A document without a section is split whole.
    """
    text = F.col("text")
    none = F.lit(None).cast("string")
    each = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(k).alias("section"), F.lit(t).alias("title")) for i, (k, t) in enumerate(titles.items())])
    named = F.transform(each, lambda t: F.struct(t["section"].alias("section"), t["title"].alias("title"), section_content(text, t["title"]).alias("body")))
    found = F.filter(named, lambda f: F.length(f["body"]) >= least)

    def chunk(kind: Column, section: Column, place: Column, of: Column, size_: Column, body: Column) -> Column:
        return F.struct(kind.alias("chunk_type"), section.alias("section"), place.alias("sub_chunk_index"), of.alias("total_sub_chunks"), size_.alias("section_size"), body.alias("text"))

    def parts(kind: Column, section: Column, head: Column, body: Column, pieces: Column) -> Column:
        return _bound(pieces, lambda p: F.transform(p, lambda x, i: chunk(kind, section, i, F.size(p), F.length(body), F.concat(head, x))))

    def of_section(f: Column) -> Column:
        large = F.length(f["body"]) > 2 * size
        pieces = F.when(large, packed(f["body"], size, overlap)).otherwise(F.array(f["body"]))
        return parts(F.when(large, "section_part").otherwise("section"), f["section"], F.concat(F.lit("## "), f["title"], F.lit("\n")), f["body"], pieces)

    bare = F.when(strip(text) != "", parts(F.lit("fallback"), F.lit(fallback), F.lit(""), text, packed(text, size, overlap)))
    rest = _bound(found, lambda f: F.when(F.size(f) > 0, F.flatten(F.transform(f, of_section))).otherwise(bare))
    key = _bound(key_info(docs), lambda k: F.array(chunk(F.lit("key_info"), F.lit("key_info"), F.lit(0), F.lit(1), F.length(k), k)))
    all_ = F.concat(key, F.coalesce(rest, F.slice(key, 1, 0)))
    return docs.select("doc_id", F.posexplode(all_).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.*")


def cut_sections(docs: DataFrame, titles: dict[str, str], least: int = MIN_SECTION, most: int | None = CHUNK_SIZE) -> DataFrame:
    """Sections cut off at ``most`` characters, or whole."""
    text = F.col("text")
    found = [F.when(F.length(section_content(text, t)) >= least, F.struct(F.lit(s).alias("section"), section_content(text, t).alias("body"))) for s, t in titles.items()]
    rows = docs.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("doc_id", "f.section", "f.body")
    return rows.withColumn("text", truncate(F.col("body"), most) if most else F.col("body")).drop("body")


def longest_chunk(chunks: DataFrame) -> DataFrame:
    """C8 as it was: only the longest stored chunk of each document."""
    return chunks.groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))


def section_rows(chunks: DataFrame, **options) -> DataFrame:
    """The longest stored chunk of each document, parsed again into section chunks, a row each with a node id.

    Ties go to the text that is last by code points; null texts count as absent,
    and a document without any text has its key information only. ``options``:
    those of ``section_chunks``.
    """
    rows = section_chunks(longest_chunk(chunks), **options)
    return rows.select(F.concat_ws("_", F.col("doc_id").cast("string"), F.lit("section"), F.col("chunk_index").cast("string")).alias("node_id"), "*")


def sentence_windows(docs: DataFrame, window: int = WINDOW, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per sentence of the whole text, with the sentences up to ``window`` before and behind it.

    The window is cut out of the document's own array, so nothing is shuffled.
    """
    return _windows(docs.select(*keys, sentences(F.col("text")).alias("__s")), window, keys)


def base_windows(docs: DataFrame, window: int = WINDOW, keys: Sequence[str] = ("doc_id",), size: int = BASE_SIZE, overlap: int = BASE_OVERLAP) -> DataFrame:
    """Sentence windows behind a base split.

    Whole sentences are packed to base chunks of ``size`` words with ``overlap``
    words in common. Each sentence of a base chunk is a row, and no window goes
    beyond its base chunk; sentences in an overlap come once for each. All in
    the row, without a shuffle. Null and empty texts give no rows.
    """
    d = docs.select(*keys, F.posexplode(packed_sentences(F.col("text"), size, overlap)).alias("base_index", "__s"))
    return _windows(d, window, [*keys, "base_index"])


def _windows(d: DataFrame, window: int, keys: Sequence[str]) -> DataFrame:
    s = F.col("__s")
    around = F.array_join(F.slice(s, F.greatest(F.col("sentence_index") + 1 - window, F.lit(1)), F.least(F.col("sentence_index"), F.lit(window)) + window + 1), " ")
    d = d.select(*keys, "__s", F.posexplode("__s").alias("sentence_index", "text"))
    return d.select(*keys, "sentence_index", "text", around.alias("window_text"))


def row_windows(rows: DataFrame, group: str, order: str, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The texts of neighbouring rows of a group, joined."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-window, window)
    return rows.withColumn("window_text", F.array_join(F.collect_list(text).over(w), " "))
