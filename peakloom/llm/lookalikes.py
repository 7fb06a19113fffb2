"""Problem 9: one consistent form for texts that look the same (confusables skeleton).

A skeleton is made in three steps: decompose canonically, replace every character by the prototype of the
characters that look like it, decompose again. Texts look the same if their skeletons are equal.

Prototypes come from two sources. Rules over the Unicode character database replace wide, narrow and font
forms, kinds of blank, and compatibility characters that keep their shape; they leave raised, lowered,
circled and fractional forms alone, since those look different. A table of the capitals and signs that share a
shape across scripts, with rules for their small letters, adds the rest. Letter case, digits, accents and punctuation are kept,
as are Greek small letters that differ visibly in running text (α, σ, ω).
Characters without a shape of their own are dropped, except where they make one: a joiner between two
pictographs, and a variation selector after a symbol.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.session import cut, table

# Capitals, and signs of their shape, that look like the Latin capital before the colon. Their small letters and
# Lisu's letters follow by rule.
CAPITALS = """
A: А Α Ꭺ ᗅ 𐊠 𖽀
B: В Β Ᏼ ᗷ Ꞵ 𐊂 𐊡 𐌁
C: С Ϲ Ꮯ Ⲥ 𐊢 𐌂 𐐕 𐔜
D: Ꭰ ᗞ ᗪ
E: Е Ε Ꭼ ⋿ ⴹ 𐊆
F: Ϝ ᖴ Ꞙ 𐊇 𐊥 𐔥
G: Ԍ Ꮐ Ᏻ
H: Н Η Ꮋ ᕼ Ⲏ 𐋏
I: І Ι Ӏ Ⲓ ⵏ 𐌉
J: Ј Ϳ Ꭻ ᒍ Ʝ
K: К Κ Ꮶ ᛕ Ⲕ 𐔘
L: Ꮮ ᒪ Ⳑ 𐐛 𐔦
M: М Μ Ꮇ Ϻ ᗰ ᛖ Ⲙ 𐊰 𐌑
N: Ν Ⲛ 𐔓
O: О Ο Օ Ⲟ ⵔ 𐊒 𐊫 𐐄 𐓂 𐔖
P: Р Ρ Ꮲ ᑭ Ⲣ 𐊕
Q: Ԛ ⵕ
R: Ʀ Ꭱ Ꮢ ᖇ 𐒴
S: Ѕ Տ Ꮪ Ꮥ 𐊖 𐐠
T: Т Τ Ꭲ ⊤ ⟙ Ⲧ 𐊗 𐊱 𐌕
U: Ս ᑌ ∪ ⋃ 𐓎
V: Ꮩ Ѵ ᐯ ⴸ 𐔝
W: Ԝ Ꮃ Ꮤ
X: Х Χ ᙭ ᚷ ╳ Ⲭ ⵝ Ꭓ 𐊐 𐊴 𐌗 𐌢 𐔧
Y: Ү У Υ Ꭹ Ꮍ Ⲩ 𐊲
Z: Ζ Ꮓ 𐋵
"""
# Small letters that no rule gives, Greek capitals and signs, and Han that look like Katakana.
OTHERS = """
a: а ɑ
b: Ь Ꮟ ᑲ ᖯ Ƅ
c: ϲ
d: ԁ Ꮷ ᑯ
e: е ҽ ℮ ꬲ
f: ſ ք ꬵ ꞙ
g: ɡ ց ᶃ ƍ
h: һ հ Ꮒ
i: і ı ɩ ι Ꭵ ꙇ
j: ј ϳ
l: ӏ Ɩ ו ן ا ᛁ
n: ո ռ
o: ο օ ഠ ჿ ס ᴑ ꬽ
p: р ρ ⍴ ⲣ
q: ԛ զ գ
r: г ᴦ ⲅ ꭇ ꭈ
s: ƽ
u: ս υ ʋ ꞟ ꭎ ꭒ
v: ν ∨ ⋁
w: ɯ ѡ ա
y: у ү γ ɣ ყ ỿ ꭚ
ᴋ: κ
ᴛ: τ
æ: ӕ
ə: ә
ɛ: ε
Δ: ∆
Σ: ∑
Π: ∏ П
Γ: Г
Φ: Ф
Λ: Л
·: ∙ ⋅ • ‧ ・
-: ‐ − ⁃
/: ⁄ ∕
:: ∶ ꞉ ː
*: ∗
~: ∼
|: ∣ ǀ
エ: 工
カ: 力
ト: 卜
ニ: 二
ハ: 八
ロ: 口
夕: タ
"""
#: Latin letters whose small form is the capital reduced.
_SAME_IN_BOTH_CASES = frozenset("COSUVWXZ")
#: Scripts whose small letters are the capitals reduced; of Cyrillic's only those of these capitals.
_REDUCED, _REDUCED_CYRILLIC = ("CHEROKEE", "COPTIC", "DESERET", "OSAGE"), frozenset("BHKMT")
# Lisu's letters are Latin capitals, named by their sound; these names don't begin with the letter they show.
_LISU_SOUNDS = {"TSA": "F", "HA": "V", "XA": "H", "SHA": "X", "ZHA": "R", "PHA": "d", "DZA": "Z"}


def listed(text: str) -> Iterator[tuple[str, str]]:
    """(character, prototype) of a table of lines."""
    for line in text.strip().splitlines():
        prototype, _, others = line.partition(": ")
        for other in others.split():
            yield other, prototype


def small_capital(letter: str) -> str:
    """What a capital looks like in the size of a small letter: the small letter itself where both cases share a shape."""
    if letter in _SAME_IN_BOTH_CASES:
        return letter.lower()
    name = f"LATIN LETTER SMALL CAPITAL {letter}"
    try:
        return letter.lower() if letter in "IY" else unicodedata.lookup(name)
    except KeyError:
        return letter.lower()


def look_alikes() -> dict[str, str]:
    """Prototype of every character that looks like another: the listed ones, and by rule

    - the small letter of a listed capital, where its script's small letters are reduced capitals, and of Cyrillic ones whose
      Latin counterpart has one shape in both cases;
    - Latin's own small capitals of such letters, found by their names;
    - Lisu's letters, found by their names.
    """
    table = dict(listed(OTHERS))
    for capital, letter in listed(CAPITALS):
        table[capital] = letter
        small, script = capital.lower(), unicodedata.name(capital, "").split(" ")[0]
        if small != capital and small not in table and (script in _REDUCED or script == "CYRILLIC" and letter in _SAME_IN_BOTH_CASES | _REDUCED_CYRILLIC):
            table[small] = small_capital(letter)
    for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        try:
            own = unicodedata.lookup(f"LATIN LETTER SMALL CAPITAL {letter}")
        except KeyError:
            continue
        if small_capital(letter) != own:
            table[own] = small_capital(letter)
    for code in range(0xA4D0, 0xA4F8):
        sound = unicodedata.name(chr(code), "").rpartition(" ")[2]
        if sound in _LISU_SOUNDS:
            table[chr(code)] = _LISU_SOUNDS[sound]
        elif len(sound) == 1 or (len(sound) == 2 and sound[1] == "A" and sound != "AE"):
            table[chr(code)] = sound[0]
    return table


def read_confusables(path: str) -> dict[str, str]:
    """Prototypes from a file in the form of the Unicode consortium's confusables.txt, for those who have one.

    Only single characters count; prototypes of ASCII characters are left out, so that digits and letters stay apart.
    """
    out = {}
    with open(path, encoding="utf-8-sig") as file:
        for line in file:
            fields = [f.strip() for f in line.partition("#")[0].split(";")]
            if len(fields) >= 2 and fields[0] and " " not in fields[0] and int(fields[0], 16) > 127:
                out[chr(int(fields[0], 16))] = "".join(chr(int(p, 16)) for p in fields[1].split())
    return out


#: Compatibility tags of the character database whose decomposition looks the same.
SAME_SHAPE = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>")
#: A pictograph's joiner and selector while the rest of the invisible characters is dropped.
_JOINER, _SELECTOR = "\U0010fffd", "\U0010fffc"
_JOIN, _SELECT = "\u200d", "\ufe0f"
#: Everything without a shape of its own but the joiner, variation selectors and tags.
_INVISIBLE = regex.compile(r"[[\p{Cf}\p{Default_Ignorable_Code_Point}]--[\u200d\ufe00-\ufe0f\U000e0020-\U000e007f]]", regex.V1)
_KEPT_JOINER = regex.compile(r"(?<=[\p{Extended_Pictographic}\p{Emoji_Modifier}\ufe0f])\u200d+(?=\p{Extended_Pictographic})")
_KEPT_SELECTOR = regex.compile(r"(?<=[\p{So}\p{Extended_Pictographic}])\ufe0f")
_LINE = regex.compile(r"\r\n|[\r\u0085\u2028\u2029]")


class Prototypes(dict):
    """Prototype by code point, found on first use. confusables: a file that adds to the library's own table."""

    def __init__(self, confusables: str | None = None) -> None:
        super().__init__()
        known = (read_confusables(confusables) if confusables else {}) | look_alikes()
        self.update({ord(c): p for c, p in known.items() if not c.isascii()})

    def __missing__(self, code: int) -> str:
        self[code] = out = self.prototype(chr(code))
        return out

    def prototype(self, char: str) -> str:
        if char in (_JOINER, _SELECTOR) or char.isascii():
            return char
        kind = unicodedata.category(char)
        if kind == "Zs":
            return " "
        if _INVISIBLE.match(char) or char == _JOIN or "\ufe00" <= char <= "\ufe0f":
            return ""
        tag, _, points = unicodedata.decomposition(char).partition(" ")
        if tag in SAME_SHAPE and not (tag == "<compat>" and kind == "Sk"):  # spacing accents have a width of their own
            if tag == "<compat>" and any(p in ("0020", "0028") for p in points.split()):
                return char  # bracketed or blank-based forms don't keep their shape
            return "".join(self[int(p, 16)] for p in points.split())
        return char


@lru_cache(maxsize=4)
def prototypes(confusables: str | None = None) -> Prototypes:
    return Prototypes(confusables)


def skeleton(text: str | None, confusables: str | None = None) -> str | None:
    """The skeleton of a text; null for null. Equal skeletons mean equal looks."""
    if text is None:
        return None
    text = _LINE.sub("\n", text)
    if text.isascii():
        return text
    if _JOIN in text or _SELECT in text:
        text = _KEPT_JOINER.sub(_JOINER, _INVISIBLE.sub("", text))
        text = _KEPT_SELECTOR.sub(_SELECTOR, text)
    decompose = unicodedata.normalize
    return decompose("NFD", decompose("NFD", text).translate(prototypes(confusables)))


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", *, with_form: bool = False, confusables: str | None = None) -> DataFrame:
    """(key, class BINARY, own BINARY[, form STRING]): 128-bit digests of the skeleton and of the text itself.

    Null texts have null digests and form. Texts without a visible character have a null class, as they
    belong to no class. Rows stay one to one; whole texts are read; other columns are dropped. confusables: see
    read_confusables; every worker must be able to read the file.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, class BINARY, own BINARY" + (", form STRING" if with_form else "")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            forms = [skeleton(t, confusables) for t in texts]
            columns = [
                batch.column("__key"),
                pa.array([digest(f) if f is not None and f.strip() else None for f in forms], pa.binary()),
                pa.array([None if t is None else digest(t) for t in texts], pa.binary()),
            ]
            names = [key, "class", "own"]
            if with_form:
                columns.append(pa.array(forms, pa.string()))
                names.append("form")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")).mapInArrow(make, schema)


#: Distinct texts of a class that one task pairs with another class member's block at most.
PAIR_BLOCK = 512


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, texts, members) of every row: its class with how many different texts and rows it has.

    The form for scale: one row per row, copies and guises aren't expanded into pairs. Rows without a class have null counts.
    """
    marks = fingerprints(df, key, text)
    per_text = marks.where("class IS NOT NULL").groupBy("class", "own").agg(F.count("*").alias("n"))
    sizes = per_text.groupBy("class").agg(F.count("*").alias("texts"), F.sum("n").alias("members"))
    return marks.join(sizes, "class", "left").select(key, F.lower(F.hex("class")).alias("class_id"), "texts", "members")


def look_alike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_a, key_b), key_a < key_b: pairs of rows with equal skeletons and different texts, each once.

    Exact copies of a text never meet one another: the distinct texts of a class are paired first, and only
    then are their rows attached, so that the work is that of the result. A class of many texts is one hot key: its texts
    are dealt by hash into blocks of about PAIR_BLOCK, and pairs are made per pair of blocks, which are keys of their own;
    rows are attached by text. Classes of one text, null texts and texts of blanks make no pair. Repeated rows count once.
    """
    # Read by several branches: texts are turned into skeletons once.
    marks = cut(fingerprints(df, key, text).where("class IS NOT NULL").select(F.col(key).alias("id"), "class", "own"))
    sizes = marks.groupBy("class", "own").agg(F.lit(1).alias("one")).groupBy("class").agg(F.count("*").alias("texts")).where("texts > 1")
    members = marks.join(sizes, "class")
    blocks = F.ceil(F.col("texts") / PAIR_BLOCK).cast("int")
    texts = members.select("class", "own", blocks.alias("blocks")).distinct().withColumn("block", F.pmod(F.xxhash64("own"), F.col("blocks")).cast("int"))
    # Each block meets itself and all others once: the text's block is one side, the other side is every block.
    left = texts.select("class", "own", F.col("block").alias("at"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    right = texts.select("class", F.col("own").alias("other"), F.col("block").alias("with"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"))
    both = left.join(right, ["class", "at", "with"]).where("own < other").select("own", "other", "class")
    a = members.select("class", "own", F.col("id").alias("x"))
    b = members.select("class", F.col("own").alias("other"), F.col("id").alias("y"))
    pairs = both.join(a, ["class", "own"]).join(b, ["class", "other"])
    return pairs.where("x <> y").select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its consistent form and the id of its class."""
    marks = fingerprints(table(spark, sf_dir, "documents"), with_form=True)
    return marks.select("doc_id", "form", F.lower(F.hex("class")).alias("class_id"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the classes that hold more than one text: (texts, members, classes)."""
    own = classes(table(spark, sf_dir, "documents")).where("texts > 1")
    return own.select("class_id", "texts", "members").distinct().groupBy("texts", "members").agg(F.count("*").alias("classes"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(table(spark, sf_dir, "documents"))
