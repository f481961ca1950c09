"""Problem 8: one form for texts that look the same but differ in their characters.

Method: every letter has the set of scripts in which it can be written (its own
and those that have a letter of the same shape). Within a token these sets are
intersected; the token is spelled in the first script, by a fixed order, that
all its letters share. So mixed-script tokens (`fоr` with a Cyrillic o) and
whole-script look-alikes (Cyrillic `сор`) both end in one consistent spelling,
while a word that only one script can write stays in it. If no script is
shared, each letter takes the first script it can be written in. What remains
is normalised character by character: invisible characters go, blanks of any
kind become one blank (their number stays), width forms and ligatures are
written out, hyphens are unified, accents are composed.

Two texts get one form exactly if they look identical: letter case, missing
accents, digits, words and line breaks stay different. Line ends CR LF and LF
are one kind of line break.

Scripts are Unicode's script extensions; Han, Kana, Bopomofo and Hangul go
together as they are written together, and letters common to all scripts go
with any. The table of shapes covers Latin, Cyrillic, Greek, Armenian and
Cherokee. Left out on purpose: letters alike in some fonts or positions only
(`rn`/`m`, `1`/`l`/`I`, `0`/`O`), digits and symbols in the shape of letters,
mathematical alphabets, and scripts without a case pair of Latin shape.

Defined results: NULL stays NULL, an empty text stays empty.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.session import cut

# Letters of one shape in Latin, Cyrillic, Greek, Armenian and Cherokee; a dot where a script has none.
SHAPES = """
A А Α . Ꭺ
B В Β . Ᏼ
C С Ϲ . Ꮯ
D . . . Ꭰ
E Е Ε . Ꭼ
G Ԍ . . Ꮐ
H Н Η . Ꮋ
I І Ι . .
J Ј Ϳ . Ꭻ
K К Κ . Ꮶ
L . . . Ꮮ
M М Μ . Ꮇ
N . Ν . .
O О Ο Օ .
P Р Ρ . Ꮲ
Q Ԛ . . .
R . . . Ꭱ
S Ѕ . Տ Ꮪ
T Т Τ . Ꭲ
U . . Ս .
V Ѵ . . Ꮩ
W Ԝ . . Ꮃ
X Х Χ . .
Y Ү Υ . Ꮍ
Z . Ζ . Ꮓ
a а . . .
b . . . Ꮟ
c с ϲ . .
d ԁ . . .
e е . . .
g . . ց .
h һ . հ .
i і . . Ꭵ
j ј ϳ . .
n . . ո .
o о ο օ .
p р ρ . .
q ԛ . զ .
s ѕ . . .
u . υ ս .
v ѵ ν . .
w ԝ . . .
x х . . .
y у γ . .
. П Π . .
. Г Γ . .
. Ф Φ . .
. к κ . .
"""
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee")
# Further letters that look like one of the same or another script.
VARIANTS = {"Ӏ": "I", "ɑ": "a", "ɡ": "g", "Ꮢ": "R", "Ꮤ": "W"}
# Scripts told apart; letters of any other one are told by the first word of their names.
KNOWN = (
    "Latin Cyrillic Greek Armenian Cherokee Han Hiragana Katakana Bopomofo Hangul Hebrew Arabic Syriac Thaana Devanagari Bengali Gurmukhi "
    "Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala Thai Lao Tibetan Myanmar Georgian Ethiopic Khmer Mongolian Coptic Glagolitic Gothic"
).split()
# Scripts that are written together, and what they are called then.
TOGETHER = {"Han": ("Jpan", "Kore", "Hanb"), "Hiragana": ("Jpan",), "Katakana": ("Jpan",), "Hangul": ("Kore",), "Bopomofo": ("Hanb",)}
# Hyphens that look like the hyphen-minus.
HYPHENS = "\u2010\u2011\ufe63\uff0d"
# Letters and fillers that print nothing although they are no format characters.
BLANK_LETTERS = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"

#: Per letter, its spelling in each script that has the shape.
SPELLINGS: dict[str, dict[str, str]] = {}
for row in SHAPES.split("\n"):
    spelled = {script: letter for script, letter in zip(SCRIPTS, row.split()) if letter != "."}
    for letter in spelled.values():
        SPELLINGS[letter] = spelled
for letter, like in VARIANTS.items():
    SPELLINGS[letter] = SPELLINGS[like]


_SCRIPTS = {name: regex.compile(rf"\p{{scx={name}}}") for name in [*KNOWN, "Common", "Inherited"]}


@lru_cache(maxsize=1 << 16)
def scripts(letter: str) -> frozenset[str] | None:
    """The scripts a letter is used in, those written together included; None if it goes with any."""
    own = {name for name in KNOWN if _SCRIPTS[name].match(letter)}
    if own:
        return frozenset(own | {t for name in own for t in TOGETHER.get(name, ())})
    if _SCRIPTS["Common"].match(letter) or _SCRIPTS["Inherited"].match(letter):
        return None
    return frozenset({unicodedata.name(letter, "?").partition(" ")[0]})


@lru_cache(maxsize=1 << 16)
def _resolved(letter: str) -> frozenset[str] | None:
    """The scripts a letter is used in or has the shape of a letter in."""
    return frozenset(SPELLINGS[letter]) if letter in SPELLINGS else scripts(letter)


@lru_cache(maxsize=1 << 16)
def _basic(ch: str) -> str:
    """A character without regard to its neighbours."""
    cat = unicodedata.category(ch)
    if ch in HYPHENS:
        return "-"
    if cat == "Zs" or ch == "\t":
        return " "
    if cat == "Cf" or ch in BLANK_LETTERS or "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if cat == "Cc":
        return ch if ch in "\n\x0b\x0c\x85" else ""
    tag, _, parts = unicodedata.decomposition(ch).partition("> ")
    if tag in ("<wide", "<narrow") or (tag == "<compat" and "LIGATURE" in unicodedata.name(ch, "")):
        return "".join(_basic(chr(int(p, 16))) for p in parts.split())
    return ch


def _spell(letters: list[str]) -> list[str]:
    """One token's letters in the one script all of them can be written in."""
    shared = None
    for c in letters:
        own = _resolved(c)
        if own is not None:
            shared = own if shared is None else shared & own
    for script in SCRIPTS:
        if shared and script in shared:
            return [SPELLINGS.get(c, {}).get(script, c) for c in letters]
    return letters if shared or shared is None else [next(iter(SPELLINGS[c].values())) if c in SPELLINGS else c for c in letters]


def _spelled(chars: str) -> list[str]:
    """Decomposed characters with each word's letters in one script."""
    out: list[str] = []
    letters: list[int] = []
    for ch in [*chars, ""]:
        cat = unicodedata.category(ch) if ch else ""
        if cat[:1] == "L":
            letters.append(len(out))
        elif cat[:1] != "M" and letters:
            for i, c in zip(letters, _spell([out[i] for i in letters])):
                out[i] = c
            letters = []
        out.append(ch)
    return out[:-1]


@lru_cache(maxsize=1 << 18)
def token_form(token: str) -> str:
    """The form of a maximal run that has a character beyond ASCII."""
    return unicodedata.normalize("NFC", "".join(_spelled(unicodedata.normalize("NFD", "".join(map(_basic, token))))))


def token_parts(token: str) -> list[tuple[str, int, int]]:
    """The form of a token in parts that belong together: characters, and the first and last place in the token they come from.

    A part is a letter with its marks, or several that are composed to one.
    """
    origin = [(c, i) for i, ch in enumerate(token) for c in unicodedata.normalize("NFD", _basic(ch))]
    # Marks change places only behind their letter, so letters keep theirs in order.
    heads = [k for k, (c, _) in enumerate(origin) if k == 0 or unicodedata.combining(c) == 0]
    spelled = "".join(_spelled(unicodedata.normalize("NFD", "".join(c for c, _ in origin))))
    out: list[tuple[str, int, int]] = []
    for lo, hi in zip(heads, [*heads[1:], len(origin)]):
        at = [i for _, i in origin[lo:hi]]
        part = unicodedata.normalize("NFC", spelled[lo:hi])
        if out and unicodedata.normalize("NFC", out[-1][0] + part) != out[-1][0] + part:
            before = out.pop()
            out.append((unicodedata.normalize("NFC", before[0] + part), min(before[1], *at), max(before[2], *at)))
        else:
            out.append((part, min(at), max(at)))
    return out


@lru_cache(maxsize=1 << 18)
def token_kind(token: str) -> str | None:
    """`mixed` if a word of a token is written in letters of no one script, `whole` if it is but would be spelled in another one; else None."""
    kind = None
    for word in re.findall(r"[^\W\d_]+", unicodedata.normalize("NFC", "".join(map(_basic, token)))):
        own = [s for s in map(scripts, word) if s is not None]
        if own and not frozenset.intersection(*own):
            return "mixed"
        if _spell(list(word)) != list(word):
            kind = "whole"
    return kind


TOKEN = re.compile(r"[A-Za-z]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")
#: Characters that fall away or become a blank wherever they stand; they go first, as they may stand within tokens.
SIMPLE = {
    c: _basic(c)
    for c in map(chr, [*range(0x20), *range(0x7F, 0xA1), 0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x1680, 0x17B4, 0x17B5, 0x180E, *range(0x2000, 0x2010), *range(0x202A, 0x2030), *range(0x205F, 0x2070), 0x3000, 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0])
    if _basic(c) != c
}
LINE_END = re.compile(r"\r\n?")


def form(text: str) -> str:
    """The one form of a text."""
    if "\r" in text:
        text = LINE_END.sub("\n", text)
    for c in SIMPLE.keys() & set(text):
        text = text.replace(c, SIMPLE[c])
    return text if text.isascii() else TOKEN.sub(lambda m: token_form(m.group()), text)


def form_offsets(text: str) -> tuple[str, list[int], list[int]]:
    """The form of a text and, for each of its characters, where in the text that begins and ends which it comes from."""
    kept, at = [], []
    for i, c in enumerate(text):
        c = ("" if text[i + 1 : i + 2] == "\n" else "\n") if c == "\r" else SIMPLE.get(c, c)
        if c:
            kept.append(c)
            at.append(i)
    plain = "".join(kept)
    out, starts, ends, last = [], [], [], 0
    for m in TOKEN.finditer(plain):
        between = at[last : m.start()]
        out.append(plain[last : m.start()])
        starts += between
        ends += [i + 1 for i in between]
        for part, lo, hi in token_parts(m.group()):
            out.append(part)
            starts += [at[m.start() + lo]] * len(part)
            ends += [at[m.start() + hi] + 1] * len(part)
        last = m.end()
    rest = at[last:]
    return "".join([*out, plain[last:]]), starts + rest, ends + [i + 1 for i in rest]


def forms(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each document's text in the one form."""

    @F.pandas_udf("string")
    def one_form(s: pd.Series) -> pd.Series:
        return s.map(form, na_action="ignore")

    return docs.select("doc_id", one_form(text).alias("form"))


def confusables(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_mixed, n_whole): tokens written in several scripts, and tokens that look like ones of another script."""

    @F.pandas_udf("struct<n_mixed:int,n_whole:int>")
    def counts(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            got = [token_kind(m) for m in TOKEN.findall(x)] if not x.isascii() else []
            out.append((got.count("mixed"), got.count("whole")))
        return pd.DataFrame(out, columns=["n_mixed", "n_whole"], dtype="int32")

    return docs.filter(F.col(text).isNotNull()).select("doc_id", counts(text).alias("c")).select("doc_id", "c.*")


def digests(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """128-bit digests of each text and of its form; texts without a visible character are left out."""

    @F.pandas_udf("struct<form_key:binary,text_key:binary>")
    def keys(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            f = form(x)
            key = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            out.append((key(f), key(x)) if f.strip() else (None, None))
        return pd.DataFrame(out, columns=["form_key", "text_key"], dtype=object)

    c = F.col(text) if isinstance(text, str) else text
    return docs.filter(c.isNotNull()).select("doc_id", keys(c).alias("k")).filter("k.form_key IS NOT NULL").select("doc_id", "k.*")


def look_alikes(docs: DataFrame) -> DataFrame:
    """Pairs of documents whose texts differ but look identical.

    Exact copies are no pairs, so a form's documents are first counted per
    distinct text; only forms with several texts are joined, and only their
    different texts with each other, before the documents of each are added.
    The work is thus as large as the result, however many copies a text has.
    """
    hashed = cut(digests(docs))
    texts = hashed.groupBy("form_key", "text_key").agg(F.count("*").alias("n"))
    several = texts.groupBy("form_key").agg(F.count("*").alias("texts")).filter("texts > 1").select("form_key")
    kept = cut(hashed.join(several, "form_key", "left_semi"))
    variants = kept.select("form_key", "text_key").distinct()
    other = variants.select("form_key", F.col("text_key").alias("other_key"))
    pairs = variants.join(other, "form_key").filter("text_key < other_key")
    a = kept.select(F.col("doc_id").alias("x"), "form_key", "text_key")
    b = kept.select(F.col("doc_id").alias("y"), "form_key", F.col("text_key").alias("other_key"))
    return (
        pairs.join(a, ["form_key", "text_key"]).join(b, ["form_key", "other_key"])
        .select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
    )
