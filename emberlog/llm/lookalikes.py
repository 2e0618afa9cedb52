"""Visually identical text with different characters: one form for all texts that look the same in print.

Two maps are built from Unicode's own decompositions and the shapes of letters: ``printed`` (compatibility forms, kinds of
space, look-alike letters; invisible characters dropped) and ``bare`` (the same, accents dropped too). Letters of any script
are of one shape if Unicode's confusables (of the ICU library that Spark brings) give them one skeleton, but for letters that
differ in case, digits, punctuation and ASCII letters; a short table of shapes goes before. Texts with equal ``bare`` are
candidates; those are grouped, in SQL, by their ``printed`` form under the accent- and case-sensitive UNICODE collation, under
which composed and combining accents are equal. Of each class the plainest, then smallest text is the canonical member, and it
is joined back to every page of the class.

Defined results
    * case, accents, punctuation, digits, ordinary ASCII among each other, line breaks, and one or two spaces stay different.
    * null texts have no form and are in no class; the empty text is equal to itself only.
    * equal texts are one member of a class; a class of one text keeps that text as its form.
    * rows without doc_id are left out; a repeated row counts once in classes and pairs. Empty input: empty. Extra columns are ignored.

Scale: texts are mapped where they are read, in Arrow batches; only 64-bit and md5 fingerprints are shuffled. Equal texts are one member
before anything is grouped, so copies never meet in a group. Texts are read a second time, and only those of the candidates, one copy of
each, leave their task: the others are told by a bitmap of bounded size.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b, md5
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.skew import Bitmap
from emberlog.plans.session import cut

# Letters of other scripts that are printed like the letter in front.
SAME_SHAPE = """
A Α А Ꭺ ꓮ
B Β В Ᏼ ꓐ
C Ϲ С Ꮯ ꓚ
D Ꭰ ꓓ
E Ε Е Ꭼ ꓰ
F Ϝ ꓝ
G Ԍ Ꮐ ꓖ
H Η Н Ꮋ ꓧ
I Ι І Ӏ ꓲ
J Ϳ Ј Ꭻ ꓙ
K Κ К Ꮶ ꓗ
L Ꮮ ꓡ
M Μ М Ϻ Ꮇ ꓟ
N Ν ꓠ
O Ο О Օ ꓳ
P Ρ Р Ꮲ ꓑ
Q Ԛ
R Ꮢ ꓣ
S Ѕ Տ Ꮪ ꓢ
T Τ Т Ꭲ ꓔ
U Ս ꓴ
V Ѵ Ꮩ ꓦ
W Ԝ Ꮃ ꓪ
X Χ Х ꓫ
Y Υ Ү ꓬ
Z Ζ Ꮓ ꓜ
a а α ɑ
c с ϲ
d ԁ
e е
g ɡ ց
h һ հ
i і ɩ ι
j ј ϳ
l ӏ
n ո
o о ο օ
p р ρ
q ԛ զ
s ѕ
u ս υ
v ν ѵ
w ԝ
x х
y у γ ү
П Π
Г Γ
Ф Φ
к κ
ф φ
ß β
"""

#: Characters with no width: soft hyphen, joiners, zero-width spaces, direction marks, variation selectors, byte order mark.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]


@cache
def same_shape() -> dict[str, str]:
    return {other: line[0] for line in SAME_SHAPE.strip().split("\n") for other in line.split()[1:]}


def shapes(spark: SparkSession) -> dict[str, str]:
    """Letter -> the letter that stands for its shape: the table above, then Unicode's confusables, read once from Spark's own library."""
    return _shapes(spark.sparkContext.applicationId, spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton)


_LETTERS = 0x20000  # beyond lie ideographs
_SHAPES: dict[str, dict[str, str]] = {}


def _shapes(application: str, skeleton) -> dict[str, str]:
    if application not in _SHAPES:
        letters = [chr(c) for c in range(0x41, _LETTERS) if unicodedata.category(chr(c))[0] == "L" and unicodedata.normalize("NFKD", chr(c)) == chr(c)]
        _SHAPES.clear()
        _SHAPES[application] = letter_classes(letters, skeleton("\n".join(letters)).split("\n"))
    return _SHAPES[application]


def letter_classes(letters: list[str], skeletons: list[str]) -> dict[str, str]:
    """Letter -> head of its class, of letters with equal skeletons of one letter (accents may follow) or the skeleton of an ASCII letter.

    No two ASCII letters and no two cases of a letter get into one class: where a skeleton has both, capitals are a class of their own.
    """
    fixed, groups = same_shape(), {}
    for c, s in zip(letters, skeletons):
        groups.setdefault(s, []).append(c)
    out = dict(fixed)
    for s, members in groups.items():
        if len(members) < 2 or not (sum(not unicodedata.combining(x) for x in s) == 1 or any(c.isascii() for c in members)):
            continue
        ascii_, known = [c for c in members if c.isascii()], [fixed.get(c, c) for c in members if c in fixed or c in fixed.values()]
        if len(ascii_) > 1:  # I and l
            parts = [[c for c in members if c.isupper()], [c for c in members if not c.isupper()]]
            heads = [next(c for c in ascii_ if c in part) for part in parts]
        else:
            head = [*ascii_, *known, members[0]][0]
            both = {x for c in members if c.lower() != c and c.lower() in members for x in (c, c.lower())}
            other = [c for c in both if c.isupper() != head.isupper()]
            parts = [[c for c in members if c not in other], sorted(other)]
            heads = [head, *parts[1][:1]]
        for head, part in zip(heads, parts):
            for c in part:
                if c != head and not c.isascii() and c not in fixed and c not in fixed.values():
                    out[c] = head
    return out


def char_map(shape: dict[str, str], accents: bool) -> dict[int, str]:
    """Code point -> its printed form (composed), with or without accents; only those that change. '' drops the character."""
    out = dict.fromkeys(INVISIBLE, "")
    for c in chain(range(0x80, _LETTERS), range(0x2F800, 0x2FA20)):
        ch = chr(c)
        if c in out or 0xD800 <= c < 0xE000 or 0xAC00 <= c < 0xD7A4 or unicodedata.category(ch) in ("Cn", "Co"):
            continue
        if unicodedata.category(ch) == "Zs":
            out[c] = " "
            continue
        parts = "".join(shape.get(p, p) for p in unicodedata.normalize("NFKD", ch))
        if not accents:
            parts = "".join(p for p in parts if not unicodedata.combining(p))
        new = unicodedata.normalize("NFC", parts)
        if new != ch and not ("\n" in new or "\r" in new):
            out[c] = new
    return out


def fingerprints(rows: DataFrame) -> DataFrame:
    """doc_id, bare (64 bits of the form without accents), text_id (md5 of the text) of every row."""
    held = rows.sparkSession.sparkContext.broadcast(char_map(shapes(rows.sparkSession), accents=False))  # one entry per character

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for b in batches:
            bare, ids = [], []
            for t in b.column(1).to_pylist():
                whole = t.encode()
                plain = whole if t.isascii() else t.translate(table).encode()
                bare.append(int.from_bytes(blake2b(plain, digest_size=8).digest(), "big", signed=True))
                ids.append(md5(whole, usedforsecurity=False).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bare, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "bare", "text_id"])

    return rows.mapInArrow(look, "doc_id bigint, bare bigint, text_id binary")


def printed_forms(rows: DataFrame) -> DataFrame:
    """(doc_id, text_id, bare, text) with ``printed``: the text with every character in its printed form."""
    held = rows.sparkSession.sparkContext.broadcast(char_map(shapes(rows.sparkSession), accents=True))
    columns = ["doc_id", "text_id", "bare", "text"]

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for b in batches:
            new = [t if t.isascii() else t.translate(table) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=[*columns, "printed"])

    return rows.select(*columns).mapInArrow(form, "doc_id bigint, text_id binary, bare bigint, text string, printed string")


def readable(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null and text <> ''")


def print_classes(docs: DataFrame) -> DataFrame:
    """Classes of two or more different texts that look the same: doc_id, text_id (md5 of the text), form_id, form.

    ``form`` is the canonical member's text, ``form_id`` the least doc_id that has exactly this text.
    """
    spark = docs.sparkSession
    ids = cut(fingerprints(readable(docs)).distinct())
    several = cut(ids.groupBy("bare").agg(F.min("text_id").alias("a"), F.max("text_id").alias("b")).filter("a <> b").select("bare"))
    candidates = cut(Bitmap(several, "bare").kept(ids, "bare").join(several, "bare", "left_semi"))
    one_each = cut(candidates.groupBy("bare", "text_id").agg(F.min("doc_id").alias("doc_id")))
    texts = Bitmap(one_each, "doc_id").kept(readable(docs), "doc_id").join(one_each, "doc_id")
    texts = cut(printed_forms(texts.filter(F.unhex(F.md5("text")) == F.col("text_id")).dropDuplicates(["doc_id", "text_id"])))
    classes = spark.sql(
        """SELECT bare, printed COLLATE UNICODE AS look, min(struct(printed <> text AS changed, text, doc_id)) AS canon
           FROM {texts} GROUP BY bare, printed COLLATE UNICODE HAVING count(*) > 1""",
        texts=texts,
    )
    members = spark.sql(
        """SELECT t.bare, t.text_id, c.canon.doc_id AS form_id, c.canon.text AS form
           FROM {texts} t JOIN {classes} c ON t.bare = c.bare AND t.printed COLLATE UNICODE = c.look""",
        texts=texts,
        classes=classes,
    )
    return candidates.join(members, ["bare", "text_id"]).select("doc_id", "text_id", "form_id", "form")


def consistent_forms(docs: DataFrame) -> DataFrame:
    """Every page with the form of its text: doc_id, form_id, form (null text: null form); a repeated row gives a repeated form.

    Only pages that may be in a class are joined with the classes' forms; the others keep their text where they are.
    """
    classes = cut(print_classes(docs).select("doc_id", F.col("text_id"), F.col("form_id").alias("__fid"), F.col("form").alias("__form")))
    rows = Bitmap(classes, "doc_id").marked(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null"), "doc_id", "maybe")
    same = F.unhex(F.md5("text")) == F.col("text_id")
    joined = rows.filter("maybe").join(classes.withColumnRenamed("doc_id", "of").alias("c"), (F.col("of") == F.col("doc_id")) & same, "left")
    formed = joined.select("doc_id", F.coalesce("__fid", "doc_id").alias("form_id"), F.coalesce("__form", "text").alias("form"))
    return formed.unionByName(rows.filter("not maybe").select("doc_id", F.col("doc_id").alias("form_id"), F.col("text").alias("form")))


def look_equal_pairs(docs: DataFrame, *, chunk: int = 4096) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: pages that look the same in print and differ in code points.

    Pairs are formed between the different texts of a class, then spread over the pages that have them; the pages of one text are
    dealt out in chunks of about ``chunk``, so that a text with very many copies is no single task.
    """
    members = cut(print_classes(docs).select("doc_id", "text_id", "form_id"))
    sizes = members.groupBy("form_id", "text_id").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks"))
    dealt = members.join(sizes, ["form_id", "text_id"]).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")))

    def side(df: DataFrame, n: str) -> DataFrame:
        return df.select("form_id", *[F.col(c).alias(c + n) for c in df.columns if c != "form_id"])

    texts = side(sizes, "_a").join(side(sizes, "_b"), "form_id").filter("text_id_a < text_id_b")
    for n in ("_a", "_b"):
        texts = texts.withColumn("chunk" + n, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks" + n) - 1)))
    for n in ("_a", "_b"):
        texts = texts.join(side(dealt.select("form_id", "text_id", "chunk", "doc_id"), n), ["form_id", "text_id" + n, "chunk" + n])
    return texts.select(F.least("doc_id_a", "doc_id_b").alias("doc_id_a"), F.greatest("doc_id_a", "doc_id_b").alias("doc_id_b")).distinct()
