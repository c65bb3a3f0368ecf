"""Reading grade of English prose: classic formulas over cleaned sentences, combined by their median."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common words that tell English from its neighbours, and words of those that English lacks.
ENGLISH = frozenset(
    "the of and to in is was that it for on with as at by from or be are were an this not had has have but which its "
    "they he she we you his her their our will would can could may been when who what there if no so than then into "
    "after before over under near up out all more most some one two first last each every other only how where why "
    "does do did said says a i my your us them him me".split()
)
FOREIGN = frozenset(
    "der die das und ist nicht ein eine den dem des zu mit auf für von im wird wurde werden nach sich auch noch "
    "el la los las de del que y en un una es por con para se su al lo como más fue ha sobre entre hasta cerca "
    "le les des du et est dans une pour qui sur au aux ne pas il elle ce cette plus par vers sont été "
    "het een van dat niet zijn voor aan bij naar ook maar wordt".split()
)
_FENCE = re.compile(r"^\s*(?:```|~~~)[^\n]*\n.*?(?:^\s*(?:```|~~~)[^\n]*$|\Z)", re.S | re.M)
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>")
_URL = re.compile(r"\[([^\]\n]{0,300})\]\([^()\s]{0,500}\)|<?\b(?:https?|ftp)://\S+|\bwww\.\S+")
_QUOTED = re.compile(r"[\"“„«»][^\"“”„«»\n]{12,}[\"”“«»]")
_PLAIN = re.compile(r"[A-Za-z'’-]+[.,;:!?]*")
_QUOTES = frozenset("\"“”„«»")
_BULLET = re.compile(r"^\s*(?:[-*+•‣·]|\(?\d{1,3}[.)]|\(?[a-z]\))\s+")
_NOISE = re.compile(r"[{}\[\]|=<>\\_@#$^~`]|;\S|::|\(\)|\t|://|\w=\w")
_WORD = re.compile(r"[A-Za-zÀ-ɏ]+(?:['’-][A-Za-zÀ-ɏ]+)*")
_ABBREVIATED = re.compile(r"\b(?:cf|approx|Approx|sect|Sect|fig|Fig|eq|Eq|no|No|vs|etc|al|ca|Dr|Mr|Mrs|Ms|St|a\.m|p\.m|max|min|resp)\.$")
_END = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s+[\"'“‘(\[]?[A-Z0-9])|;\s+(?=[A-Z])|[.!?…]+[\"'”’)\]]*\s*$")
_CLOSED = re.compile(r"[.!?…:;][\"'”’)\]*_]*\s*$")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")


def syllables(word: str) -> int:
    """Syllables of an English word by rules in the manner of hyphenation: vowel groups are nuclei, silent endings are
    none, and some vowel pairs are parted."""
    w = re.sub("[^a-z]", "", word.lower())
    if len(w) <= 3:
        return 1
    n = len(re.findall(r"[aeiouy]+", re.sub(r"^y", "", w)))
    if re.search(r"[^aeiouyl]e$|[aeiouy]le$|[^tdaeiouy]ed$|[^aeiouscxzg]es$|(?<![sc])hes$", w) and not re.search(r"[^aeiouy]le$", w):
        n -= 1
    n += len(re.findall(r"i[aou](?!u?s$)|io(?=[^nu])|[^qg]ua|eo(?!u)|ying|[aeiou]ing|uou|ism$|[aeiouy][^aeiouy]+ier$", w))
    n -= len(re.findall(r"[tscgx]i(?:on|ous|al|an|ent|a)", w))
    return max(n, 1)


def _paragraph(lines: list[str]) -> list[str]:
    """A paragraph's lines as units of text: hard-wrapped lines joined, lists and bare lines kept apart."""
    if any(_BULLET.match(x) for x in lines):
        units: list[str] = []
        for x in lines:
            if _BULLET.match(x):
                units.append(_BULLET.sub("", x))
            elif units:
                units[-1] += " " + x.strip()
            else:
                units.append(x)
        return units
    widest = max(map(len, lines))
    breaks = [(a, b.lstrip()) for a, b in zip(lines, lines[1:]) if not _CLOSED.search(a)]  # the others part sentences either way
    lower = sum(b[:1].islower() for _, b in breaks)
    going_on = sum(b[:1].islower() or b[:1].isdigit() or len(a) + len(b.split(None, 1)[0]) >= widest for a, b in breaks)
    if lower * 2 >= len(breaks) and going_on * 2 >= len(breaks):
        return [" ".join(x.strip() for x in lines)]
    return lines


def _stray(line: str) -> bool:
    """A line of symbols, a row of a table or a log, or hardly a word."""
    words = line.split()
    return len(_NOISE.findall(line)) * 12 > len(words) or (not _CLOSED.search(line) and sum(len(w) > 1 for w in _WORD.findall(line)) < 2)


def _introduces(line: str) -> bool:
    """A line of prose, after which an indented block is a quoted piece of code and not the body of a program."""
    return sum(bool(_PLAIN.fullmatch(w)) for w in line.split()) >= 4 and bool(_CLOSED.search(line))


def sentences(text: str) -> tuple[list[list[str]], int]:
    """The words of each prose sentence, without headings, code, tables, links, quoted passages and stray lines; and
    how many characters stand in all lines but fenced code, indented code after a line of prose, headings and quoted lines
    and passages, white space apart."""
    text = (text if text.isascii() else _INVISIBLE.sub("", text)).replace("\r\n", "\n")
    text = re.sub("[\x0b\x0c\x1c-\x1f\x85\u2028\u2029\r]", "\n", text)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "://" in text or "](" in text or "www." in text:
        text = _URL.sub(" ", text)
    paragraphs: list[list[str]] = [[]]
    size = 0
    prose = block = False  # whether the last line that is not indented is prose, and a block of code stands open after it
    gap = True
    for line in text.split("\n"):
        bare = line.strip()
        heading = bare.startswith(("#", ">"))
        if bare:
            indented = line.startswith(("    ", "\t"))
            block = indented and (block or (gap and prose))
            prose = prose if indented else heading or _introduces(bare)
            if not heading and not block:
                size += len(bare) - bare.count(" ")
        gap = not bare
        if not bare or heading or bare.startswith(("|", "//", "$ ")) or line.startswith(("    ", "\t")) or _stray(bare):
            if paragraphs[-1]:
                paragraphs.append([])
            continue
        paragraphs[-1].append(line.rstrip())
    found = []
    for lines in paragraphs:
        units = _paragraph(lines) if lines else []
        for unit in units:
            unit = unit.replace("**", "").replace("__", "")
            if not _QUOTES.isdisjoint(unit):
                if unit.lstrip()[:1] not in tuple("[{") and '":' not in unit:  # strings of JSON are no quoted passages
                    size -= sum(len(q) - sum(map(str.isspace, q)) for q in _QUOTED.findall(unit))
                unit = _QUOTED.sub(" ", unit)
            if len(units) == 1 and not _CLOSED.search(unit) and len(unit.split()) < 8:
                continue
            unit, at = unit.replace("e.g.", "eg").replace("i.e.", "ie"), 0
            for end in [*_END.finditer(unit), None]:
                if end and end[0][0] == "." and _ABBREVIATED.search(unit, max(at, end.start() - 8), end.start() + 1):
                    continue
                words = _WORD.findall(unit, at, end.start() if end else len(unit))
                if len(words) >= 3:
                    found.append(words)
                at = end.end() if end else at
    return found, size


class _Facts(dict):
    """Of a word, when first asked for: syllables, letters, 1 for three syllables or more, 1 for over six letters, 1 for a
    common English word, 1 for a common foreign word or one with foreign letters. At its bound it forgets all."""

    def __missing__(self, word: str) -> tuple[int, int, int, int, int, int]:
        if len(self) >= 200_000:
            self.clear()
        low, beats = word.lower(), syllables(word)
        self[word] = facts = (beats, len(word), int(beats >= 3), int(len(word) > 6), int(low in ENGLISH), int(low in FOREIGN or not low.isascii()))
        return facts


_facts = _Facts()


def totals(words: list[str]) -> tuple[int, ...]:
    """The sums of the words' facts, after their number."""
    return len(words), *map(sum, zip(*map(_facts.__getitem__, words)))


def tongue(total: tuple[int, ...]) -> int:
    """1: a sentence has more English than foreign common words or words with foreign letters, -1: fewer, 0: as many."""
    ours, theirs = total[5:]
    return (ours > theirs) - (ours < theirs)


#: Texts of this grade or more are demanding (levels 4 and 5 of five). The rated documents of level 3 lie below 15 and
#: those of levels 4 and 5 above 22, and hardly any text lies between.
DEMANDING = 19.0


def estimates(total: tuple[int, ...], m: int = 1) -> list[float]:
    """School grades of ``m`` sentences with these totals by six classic formulas."""
    n, beats, letters, hard, big = total[:5]
    long = n / m
    return [
        0.39 * long + 11.8 * beats / n - 15.59,  # Flesch-Kincaid
        0.4 * (long + 100 * hard / n),  # Fog
        1.0430 * math.sqrt(hard * 30 / m) + 3.1291,  # SMOG
        4.71 * letters / n + 0.5 * long - 21.43,  # automated readability index
        5.88 * letters / n - 29.6 * m / n - 15.8,  # Coleman-Liau
        (long + 100 * big / n - 15) / 3.4,  # Lix on the scale of grades
    ]


def grade(text: str | None) -> float | None:
    """The grade of a text, or None if English prose isn't most of it.

    Each sentence has the median of its estimates; the text has the median of its sentences, each weighing as much as
    it has words, so foreign matter short of half the text does not move it.
    """
    if not text:
        return None
    found, size = sentences(text)
    all_totals = [totals(words) for words in found]
    own = [t for t in all_totals if tongue(t) >= 0]
    clear = sum(t[0] for t in own if tongue(t) > 0)
    words, total = sum(t[0] for t in own), sum(t[0] for t in all_totals)
    if not words or 2 * words < total or 5 * clear < total or 2 * sum(t[2] for t in own) < size:
        return None
    upto = 0
    for value, n in sorted((median(estimates(t)), t[0]) for t in own):
        upto += n
        if 2 * upto >= words:
            return value
    return None


def reading_grades(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """``(id, grade)`` of every row; the grade is null for null, empty and blank texts, other languages, logs, code,
    JSON and tables. Repeated rows come out repeatedly, texts of any length are read whole, other columns are never
    read, an empty table gives an empty result. A narrow map without a shuffle."""

    def grades(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf[["id"]].assign(grade=[grade(t) for t in pdf["text"]]).astype({"grade": "float64"})

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(grades, f"id {kind}, grade double")
    return rows.select(F.col("id").alias(id_col), F.when(F.isnan("grade"), None).otherwise(F.col("grade")).alias("grade"))
