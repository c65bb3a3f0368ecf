"""Evaluation texts inside a corpus: Wu-Manber search for item wording, then a check of each passage found."""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts that look like Latin ones, in pairs.
LOOKALIKE = (
    "аa бb вb гr дd еe ёe ѕs іi їi јj кk мm нh оo пn рp сc тt уy хx ԁd ԛq ԝw һh ӏl ցg օo "
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ӀI "
    "αa βb γy εe ηn ιi κk νv οo ρp τt υu χx ωw ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX "
    "ıi ȷj ɑa ɡg ɩi ʟl øo łl đd ħh ŧt ƒf"
)
_LATIN = {ord(pair[0]): pair[1] for pair in LOOKALIKE.split()}
_BLOCK_TAG = re.compile(r"<\s*/?\s*(?:br|p|div|li|ul|ol|td|tr|h[1-6])\b[^<>]{0,200}>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|<!--.{0,200}?-->", re.S)
_LINK = re.compile(r"\]\([^()\s]{0,500}\)")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]{2,8});")
_WORD = re.compile(r"[^\W_]+")
_PLAIN = re.compile(r"[a-z0-9]+")
_APOSTROPHE = re.compile(r"(?<=\w)['’ʼ＇](?=\w)")


def words_of(text: str) -> list[str]:
    """A text's words without letter case, punctuation, white space, line breaks, markup, invisible characters, accents
    and look-alike letters. A hyphen parts words, an apostrophe does not."""
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if "&" in text:
        from html import unescape

        text = _ENTITY.sub(lambda m: unescape(m[0]), text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    if text.isascii():
        return _PLAIN.findall(_APOSTROPHE.sub("", text).lower())
    text = unicodedata.normalize("NFKD", text.translate(_LATIN))
    text = "".join(c for c in text if c.isascii() or unicodedata.category(c) not in ("Cf", "Mn", "Me")).translate(_LATIN)
    return _WORD.findall(_APOSTROPHE.sub("", text).casefold())


def item_words(text: str) -> tuple[list[str], list[int]]:
    """An item's words and, of each, the number of the white-space word it is a part of."""
    parts, owner = [], []
    for k, raw in enumerate(text.split()):
        for w in words_of(raw):
            parts.append(w)
            owner.append(k)
    return parts, owner


class Patterns:
    """Wu-Manber tables over items' windows of ``size`` words; a symbol is a word, a block is two.

    ``shifts``, by the hash of a block: how far the search may jump when a window of the text ends with it (the least of
    the blocks with that hash); a block of no pattern allows ``size - 1``. A bucket holds the windows that end with a
    block, which are compared word by word. All of it lies in arrays, some 60 bytes a word of the items, which are built
    once and sent to the workers as they are.
    """

    SPREAD = 0x9E3779B1

    def __init__(self, items: Iterable[tuple[int, list[str], list[int], list[bool]]], size: int) -> None:
        self.size, self.ids, self.vocabulary = size, [], {}
        words, owners, hidden, bounds = array("i"), array("i"), bytearray(), [0]
        number = self.vocabulary.setdefault
        for item, parts, owner, shared in items:
            self.ids.append(item)
            words.extend([number(w, len(self.vocabulary)) for w in parts])
            owners.extend(owner)
            hidden.extend(shared)
            bounds.append(len(words))
        self.words, self.owners, self.hidden, self.bounds = words, owners, bytes(hidden), np.array(bounds, np.int64)
        self.factor = len(self.vocabulary) + 1
        flat = np.frombuffer(words, np.int32).astype(np.int64) if words else np.zeros(0, np.int64)
        pairs = flat[:-1] * self.factor + flat[1:]
        ends = np.repeat(self.bounds[1:], np.diff(self.bounds))  # of each word's item
        unseen = np.concatenate([[0], np.cumsum(np.frombuffer(self.hidden, np.uint8) == 0)])
        starts = np.flatnonzero(np.arange(len(flat)) + size <= ends)
        starts = starts[unseen[starts + size] > unseen[starts]]  # what is all shared counts for nothing, and an unshared passage has other windows
        self.blocks = np.unique(pairs[starts + size - 2])
        self.mask = (1 << max(10, (16 * max(len(starts), 1) - 1).bit_length())) - 1
        shifts = np.full(self.mask + 1, size - 1, np.uint8)
        for e in range(size - 1):
            at = starts + e
            np.minimum.at(shifts, (flat[at] * self.SPREAD + flat[at + 1]) & self.mask, size - 2 - e)
        self.shifts = shifts.tobytes()
        order = np.argsort(pairs[starts + size - 2], kind="stable")
        self.windows = starts[order].astype(np.int32)
        self.begins = np.searchsorted(pairs[starts + size - 2][order], self.blocks)
        self.begins = np.append(self.begins, len(starts)).astype(np.int32)

    def numbers(self, text: list[str]) -> list[int]:
        """A text's words as numbers of the items' words, and one more number for all others."""
        get, other = self.vocabulary.get, self.factor - 1
        return [get(w, other) for w in text]

    def item(self, n: int) -> tuple[int, list[int], list[int], list[bool]]:
        """Id, words, owners and shared marks of an item."""
        a, b = int(self.bounds[n]), int(self.bounds[n + 1])
        return self.ids[n], self.words[a:b].tolist(), self.owners[a:b].tolist(), list(map(bool, self.hidden[a:b]))

    def search(self, text: list[int]) -> dict[int, list[tuple[int, int]]]:
        """By item: where a pattern occurs, as (position in the text, position in the item). ``text``: :meth:`numbers`."""
        far, spread, mask, shifts = self.size - 1, self.SPREAD, self.mask, self.shifts
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        at, end, size = far, len(text), self.size
        while at < end:
            if jump := shifts[(text[at - 1] * spread + text[at]) & mask]:
                at += jump
                continue
            pair = text[at - 1] * self.factor + text[at]
            block = int(np.searchsorted(self.blocks, pair))
            if block == len(self.blocks) or self.blocks[block] != pair:
                at += 1  # another block with this hash
                continue
            first = at - far
            window = array("i", text[first : at + 1])
            for start in self.windows[self.begins[block] : self.begins[block + 1]].tolist():
                if self.words[start] == window[0] and self.words[start : start + size] == window:
                    n = int(np.searchsorted(self.bounds, start, "right")) - 1
                    found[n].append((first, start - int(self.bounds[n])))
            at += 1
        return found


def _reach(text: list[int], item: list[int], i: int, j: int, step: int, most: int, rate: float, spare: float) -> list[int]:
    """From (i, j) on in one direction: by number of changes, 0 to ``most``, how many item words can be passed so that
    the last one is equal in the text; ends where there are over ``spare`` changes more than ``rate`` allows for these.
    Edit distance by furthest-reaching diagonals (Landau-Vishkin)."""
    width, height = (len(text) - i, len(item) - j) if step > 0 else (i + 1, j + 1)
    far: dict[int, int] = {}  # by diagonal (text words less item words): item words passed
    best, reach = [], 0
    for edits in range(most + 1):
        now: dict[int, int] = {}
        for d in range(-edits, edits + 1):
            limit = min(height, width - d)
            before = far.get(d, -1)
            r = min(max(before + 1, far.get(d + 1, -1) + 1, far.get(d - 1, -1)), limit) if edits else 0
            if r < 0 or r + d < 0:
                continue
            while r < limit and text[i + step * (r + d)] == item[j + step * r]:
                r += 1
            now[d] = r
            while r > reach and r > before:
                if r + d > 0 and text[i + step * (r + d - 1)] == item[j + step * (r - 1)]:
                    reach = r
                r -= 1
        best.append(reach)
        if edits > rate * reach + spare:
            break
        far = now
    return best


def holds_passage(text: list[int], parts: list[int], owner: list[int], shared: list[bool], hits: list[tuple[int, int]], exact: int, loose: int, rate: float) -> bool:
    """Whether a passage around one of the hits is long enough: ``exact`` words in a row, or ``loose`` words of which at
    most ``rate`` are changed, left out or put in. Words count as the item has them between white space, without the
    wording that several items share; a passage begins and ends with a word that is equal in both."""
    hidden = {k for k, s in zip(owner, shared) if s}
    # Of the item's whole unshared words, how many begin and how many end before a part.
    begun, ended = [0], [0]
    for p, k in enumerate(owner):
        begun.append(begun[p] + (k not in hidden and (p == 0 or owner[p - 1] != k)))
        ended.append(ended[p] + (k not in hidden and (p + 1 == len(owner) or owner[p + 1] != k)))
    most = int(rate * ended[-1])

    seen: set[tuple[int, int]] = set()
    for i, j in hits:
        if (i, j) in seen:
            continue
        first, last = 0, 0
        while i + first > 0 and j + first > 0 and text[i + first - 1] == parts[j + first - 1]:
            first -= 1
        while i + last < len(text) and j + last < len(parts) and text[i + last] == parts[j + last]:
            last += 1
        seen.update((i + k, j + k) for k in range(first, last))
        if ended[j + last] - begun[j + first] >= exact:
            return True
        # One side of a passage makes up for at most ``rate * loose`` changes of the other, else it is a passage itself.
        # And if what is passed so far, both sides together, has as many too many, then what makes up for them behind it
        # is a passage with hits of its own. So no passage is lost where a side ends (two words more: parts of words).
        spare = rate * (loose + 2)
        back = [begun[j - n] for n in _reach(text, parts, i - 1, j - 1, -1, most, rate, 2 * spare)]
        ahead = [ended[j + n] for n in _reach(text, parts, i, j, 1, most, rate, spare + max(rate * (begun[j] - n) - k for k, n in enumerate(back)))]
        for a, start in enumerate(back):
            for b, end in enumerate(ahead):
                if end - start >= loose and a + b <= rate * (end - start):
                    return True
    return False


def _shared_parts(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Per item the windows of ``size`` words that another item has as well: ``(item, starts)``."""

    def windows(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [(item, start, " ".join(parts[start : start + size])) for item, text in zip(pdf["item"], pdf["text"]) for parts in [item_words(text)[0]] for start in range(len(parts) - size + 1)]
            yield pd.DataFrame(rows, columns=["item", "start", "window"])

    kind = items.schema[id_col].dataType.simpleString()
    all_windows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).mapInPandas(windows, f"item {kind}, start int, window string")
    common = all_windows.groupBy("window").agg(F.min("item").alias("a"), F.max("item").alias("b")).where("a <> b").select("window")
    return all_windows.join(common, "window", "left_semi").groupBy("item").agg(F.collect_set("start").alias("starts"))


def _prepared(rows: list, exact: int) -> Iterator[tuple[int, list[str], list[int], list[bool]]]:
    for row in rows:
        parts, owner = item_words(row["text"])
        shared = [False] * len(parts)
        for start in row["starts"] or ():
            shared[start : start + exact] = [True] * len(shared[start : start + exact])
        yield row["item"], parts, owner, shared


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str,
    doc_text: str,
    item_id: str,
    item_text: str,
    exact: int = 12,
    loose: int = 20,
    rate: float = 1 / 6.5,
    seed: int = 5,
    block_bytes: int = 16_000_000,
) -> DataFrame:
    """Documents that hold wording of evaluation items: ``(doc_id, item_id)``, each pair once.

    A passage counts that holds ``exact`` words in a row of an item, or ``loose`` of which at most ``rate`` are changed;
    wording of ``exact`` words or more that several items share does not count. Such a passage holds ``seed`` words in
    a row, so windows of that size are the patterns of the search, and passages around the hits are aligned by edit distance.

    Items are broadcast in blocks of at most about ``block_bytes`` bytes of text each (one for a usual evaluation set),
    so the corpus is scanned once per block, without a shuffle. Nulls and empty texts on either side hold nothing, items
    with fewer words than a passage are never found, an item id with several texts has the cases of each; an empty table
    on either side gives no row; other columns are never read.
    """
    usable = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).distinct()
    size = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    with_shared = usable.join(_shared_parts(usable, "item", "text", exact), "item", "left")
    corpus = docs.where(F.length(doc_text) > 0).select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text"))
    doc_kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    found = None
    for k in range(blocks):
        rows = with_shared.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()  # at most about block_bytes
        sent = docs.sparkSession.sparkContext.broadcast(Patterns(_prepared(rows, exact), seed))  # a worker reads it once

        def scan(batches: Iterator, sent=sent) -> Iterator:
            import pandas as pd

            patterns = sent.value
            for pdf in batches:
                cases = []
                for doc, text in zip(pdf["doc"], pdf["text"]):
                    tokens = patterns.numbers(words_of(text))
                    for n, hits in patterns.search(tokens).items():
                        item, parts, owner, shared = patterns.item(n)
                        if holds_passage(tokens, parts, owner, shared, hits, exact, loose, rate):
                            cases.append((doc, item))
                yield pd.DataFrame(cases, columns=["doc", "item"])

        part = corpus.mapInPandas(scan, f"doc {doc_kind}, item {item_kind}")
        found = part if found is None else found.unionByName(part)
    return found.distinct().select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))
