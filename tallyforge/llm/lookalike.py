"""One consistent form of texts that look the same, and the pairs of documents that share it."""

import functools
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.tables import settled

#: Letters of other scripts, each over the letter of the same shape (capitals with capitals).
SAME_SHAPE = (
    # Cyrillic
    ("АВЕЅІЈКМНОРСТУХԌԚԜѴҮӀ", "ABESIJKMHOPCTYXGQWVYI"),
    ("асԁеһіјоруԛѕхԝѵүӏ", "acdehijopyqsxwvyl"),
    ("ГПФк", "ΓΠΦκ"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϺ", "ABEZHIKMNOPTYXCJM"),
    ("ονϲϳ", "ovcj"),
    # Armenian
    ("ՕՍՏ", "OUS"),
    ("օսհոյցզ", "ouhnjgq"),
    # Cherokee
    ("ᎪᏴᏟᎠᎬᏀᎻᏆᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHIJKLMPRSTVWZ"),
)
#: Further characters that print nothing, beside all of the category "format": grapheme joiner,
#: Hangul fillers, Khmer inherent vowels, Mongolian selectors, variation selectors.
UNSEEN = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))
#: Characters of the category "format" that are printed.
PRINTED = ((0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD))
#: Control characters that stand for something: tab and line ends. C1 is kept as a whole: it is
#: what wrongly decoded text is made of.
KEPT_CONTROLS = "\t\n\v\f\r"
#: Names of letters of large sets of syllables, ideographs or pictures, which are not looked up.
WITHOUT_SHAPES = ("CJK", "HANGUL", "TANGUT", "KHITAN", "EGYPTIAN", "CUNEIFORM", "ANATOLIAN", "YI ", "NUSHU", "BAMUM", "VAI ", "MENDE")


@functools.cache
def _characters() -> tuple[dict[int, str], str]:
    """From the Unicode tables by rule: what characters that print nothing, spaces and wide or narrow forms become; and the letters
    that may have a look-alike in another script: those that neither decompose nor belong to a script of syllables or ideographs."""
    table: dict[int, str] = {}
    letters = []
    printed = {c for a, b in PRINTED for c in range(a, b + 1)}
    for o in range(sys.maxunicode + 1):
        c = chr(o)
        kind = unicodedata.category(c)
        if (kind == "Cf" and o not in printed) or (kind == "Cc" and (o < 0x20 or o == 0x7F) and c not in KEPT_CONTROLS):
            table[o] = ""
        elif kind == "Zs" and c != " ":
            table[o] = " "
        elif (form := unicodedata.decomposition(c)).startswith(("<wide>", "<narrow>")):
            table[o] = unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in form.split()[1:]))
        elif kind in ("Lu", "Ll", "Lo") and not form and not unicodedata.name(c, "").startswith(WITHOUT_SHAPES):
            letters.append(c)
    for a, b in UNSEEN:
        table |= dict.fromkeys(range(a, b + 1), "")
    return table, "".join(letters)


def shared_shapes(skeletons: dict[str, str]) -> dict[int, str]:
    """Letters of other scripts than Latin over the letter they look like, by a public look-alike table: letters with one skeleton
    and of one case are one shape, whose letter is the ASCII one of that case, or else the first. A letter without
    case takes an ASCII letter only if that is its skeleton. ASCII and Latin letters stay."""
    shapes: dict[tuple[str, str], list[str]] = {}
    for c, form in skeletons.items():
        shapes.setdefault((form, unicodedata.category(c)), []).append(c)
    out: dict[int, str] = {}
    for (form, kind), members in shapes.items():
        plain = [c for c in members if c.isascii()]
        to = plain[0] if plain else form if kind == "Lo" and form.isascii() and form.isalpha() and len(form) == 1 else min(members)
        if kind != "Lo" or to.isascii():
            out |= {ord(c): to for c in members if c != to and not unicodedata.name(c, "").startswith("LATIN")}
    return out


@functools.cache
def prototypes(more: tuple[tuple[int, str], ...] = ()) -> dict[int, str]:
    """What each character becomes: from the Unicode tables, SAME_SHAPE and further letter shapes."""
    table = dict(more) | _characters()[0] | {ord(a): b for many, plain in SAME_SHAPE for a, b in zip(many, plain, strict=True)}
    for o, form in list(table.items()):  # a wide form of a space, a shape whose letter has one of its own
        while (further := "".join(table.get(ord(x), x) for x in form)) != form:
            form = further
        table[o] = form
    return table


@functools.cache
def _public_shapes(application: str) -> tuple[tuple[int, str], ...]:
    from pyspark import SparkContext

    jvm, letters = SparkContext._active_spark_context._jvm, _characters()[1]
    checker = getattr(jvm.com.ibm.icu.text.SpoofChecker, "Builder")().build()
    forms = checker.getSkeleton(" ".join(letters)).split(" ")
    return tuple(sorted(shared_shapes(dict(zip(letters, forms, strict=True))).items()))


def look_alike_table(spark: SparkSession) -> dict[int, str]:
    """prototypes() with the letter shapes of the public look-alike table that comes with Spark's own libraries. Made once on
    the driver; a few thousand characters, bounded by Unicode, go to the tasks."""
    return prototypes(_public_shapes(spark.sparkContext.applicationId))


class _Table(dict):
    """For str.translate: keeps what it has once looked up, so that unlisted characters cost one lookup too."""

    def __missing__(self, o: int) -> int:
        self[o] = o
        return o


def skeleton(text: str, table: dict[int, str] | None = None) -> str:
    """The form in which texts that look the same are equal: decomposed, every character replaced by its
    prototype, decomposed again. Full and half width are one, accents are in one composition, what prints nothing is gone,
    every kind of space is a plain one, letters of other scripts are the letters they look like."""
    if text.isascii() and text.isprintable():
        return text
    table = _Table(prototypes()) if table is None else table
    return text.translate(table) if text.isascii() else unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))


def normalised(documents: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns and form, the skeleton of the whole text; null for null, empty for empty text. No shuffle."""

    shipped = look_alike_table(documents.sparkSession)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(shipped)
        for batch in batches:
            forms = [None if t is None else skeleton(t, table) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(forms, pa.string())], names=[*columns, "form"])

    read = documents.select(*columns, F.col("text").alias("__text"))
    kinds = ", ".join(f"`{c}` {k}" for c, k in read.dtypes[:-1])
    return read.mapInArrow(convert, f"{kinds}, form string")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, form_key and text_key (128-bit hashes of skeleton and stored text) of every document with something
    visible in it. Only these leave the task, not the texts."""

    shipped = look_alike_table(documents.sparkSession)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(shipped)
        for batch in batches:
            ids, forms, texts = [], [], []
            for doc, text in zip(batch.column("doc_id"), batch.column("text").to_pylist()):
                form = skeleton(text, table) if text else ""
                if form and not form.isspace():
                    ids.append(doc.as_py())
                    forms.append(xxhash.xxh3_128_digest(form.encode()))
                    texts.append(xxhash.xxh3_128_digest(text.encode()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.binary()), pa.array(texts, pa.binary())], names=["doc_id", "form_key", "text_key"])

    read = documents.select(F.col("doc_id").cast("bigint"), "text").where(F.col("text").isNotNull())
    return read.mapInArrow(convert, "doc_id bigint, form_key binary, text_key binary")


#: Documents of one spelling in one part where they are looked up and where a pair's side meets them; spellings of one form in
#: one part of the left side where spellings meet. What has more is taken in as many parts as that makes.
PER_SLOT, PER_PART, PER_FORM = 1_000_000, 10_000, 1_000


def lookalike_classes(prints: DataFrame) -> DataFrame:
    """doc_id, form_key, text_key of documents whose skeleton occurs in at least two stored spellings, with parts, which
    follows the number of documents of the spelling, and slices, which follows the number of spellings of the form.

    Spellings are combined before the shuffle, so copies of one text don't pile up. To find their members, the documents of a
    spelling are spread over parts of about PER_SLOT, and its row is repeated for each. Spellings with more than one part are at
    most rows/PER_SLOT; how they are joined is left to Spark's size rules."""
    keys = ["form_key", "text_key"]
    spellings = prints.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    several = spellings.groupBy("form_key").agg(F.count(F.lit(1)).alias("spellings")).where(F.col("spellings") > 1)
    slots = F.ceil(F.col("n") / PER_SLOT).cast("int")
    large = spellings.where(F.col("n") > PER_SLOT).select(*keys, slots.alias("slots"))
    listed = spellings.join(several, "form_key").select(*keys, F.ceil(F.col("n") / PER_PART).cast("int").alias("parts"), F.ceil(F.col("spellings") / PER_FORM).cast("int").alias("slices"), F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"))
    spread = prints.join(large, keys, "left").select(*prints.columns, F.coalesce(F.pmod(F.xxhash64("doc_id"), "slots"), F.lit(0)).cast("int").alias("slot"))
    return spread.join(listed, [*keys, "slot"]).drop("slot")


def lookalike_pairs(documents: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b: all pairs of documents that look the same and differ as stored.

    Pairs are first made of spellings (rows per spelling, not per document), then each side is joined with its
    documents: work is as large as the result, and copies of one text are never paired with one another. A spelling
    of many documents is joined in parts of about PER_PART, and a form of many spellings in slices of about PER_FORM of its
    left sides, so no task gets them all.
    Null texts and texts without anything visible have no pairs; a null doc_id has none; empty tables give no rows.
    """
    members = settled(lookalike_classes(settled(fingerprints(documents.where(F.col("doc_id").isNotNull())))))
    spellings = members.groupBy("form_key", "text_key").agg(F.max("parts").alias("parts"), F.max("slices").alias("slices"))
    left = spellings.select("form_key", F.col("text_key").alias("key_a"), F.col("parts").alias("parts_a"), F.pmod(F.xxhash64("text_key"), "slices").cast("int").alias("slice"))
    right = spellings.select("form_key", F.col("text_key").alias("key_b"), F.col("parts").alias("parts_b"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    pairs = left.join(right, ["form_key", "slice"]).where(F.col("key_a") < F.col("key_b")).drop("slice")
    part = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.col("parts")).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = members.select("form_key", F.col("text_key").alias("key_a"), part.alias("part_a"), F.col("doc_id").alias("a"))
    b = members.select("form_key", F.col("text_key").alias("key_b"), part.alias("part_b"), F.col("doc_id").alias("b"))
    one = pairs.withColumn("part_a", every("parts_a")).join(a, ["form_key", "key_a", "part_a"])
    both = one.withColumn("part_b", every("parts_b")).join(b, ["form_key", "key_b", "part_b"])
    return both.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
