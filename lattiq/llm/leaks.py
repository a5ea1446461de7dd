"""Evaluation texts that leak into a corpus: pigeonhole edit matching over words.

An excerpt of EXCERPT words may have EDITS edits. Every test item is cut into pieces so short that any excerpt of it holds
EDITS + 1 whole ones; one of them must then stand unchanged in a document that repeats the excerpt. Documents are
searched for exact hits of all pieces; what is hit is verified by Myers' bit-parallel distance: each sentence of the
item, or else each half or quarter of it, is searched in the whole document within its budget of edits, and windows
around the hits are searched near their place, for excerpts that begin or end within a sentence. What is found adds up,
over broken-up and reordered copies, to the number of words leaked.

A leak must bear the item's own names and figures. Those are told from customary words by one statistic over all
documents: how many use a word, and a pair of neighbours, outside copies. Within a copied run of COPIED_RUN words of the
item a document's words are not counted, so an item stays as it is however widely it leaks.

The items are a stated query set: they are broadcast in blocks of ITEMS_A_BLOCK, and each block meets every document in
one pass without a shuffle. Texts are taken whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEMS_A_BLOCK = 5_000
#: Words of an item that a document must repeat; edits allowed among them, and the words of one of EDITS + 1 pieces. An excerpt
#: that begins anywhere holds at least EDITS + 1 whole pieces of the item's cut: (EDITS + 1) * PIECE + PIECE - 1 <= EXCERPT.
EXCERPT, EDITS = 18, 4
PIECE = (EXCERPT + 1) // (EDITS + 2)
#: Words of a window around a hit, and edits allowed in it.
WINDOW, WINDOW_EDITS = 3 * PIECE, 3
#: Share of the words of a sentence that may be edited, dropped or added.
EDIT_SHARE = 0.35
#: Edited words do not count as repeated: this many of EXCERPT must be left.
LEAST_WORDS = EXCERPT - EDITS
#: Share of a found part's names, and of its figures, that must be the item's own.
OWN_SHARE = 0.6
#: A word is the item's own (a name or figure, not customary) if, outside copies, at most so large a share of all documents
#: has it beside any neighbour that it has in an item, and at most so large a share has it at all.
RARE_PAIR_SHARE, RARE_WORD_SHARE, LEAST_DOCUMENTS = 0.0012, 0.012, 3
#: Equal words in a row that make a copy, looked for at every PIECE-th word of a document.
COPIED_RUN = 12
#: One own word is enough in a run of so many equal words.
LONG_RUN = 9
#: Words of a leak may be further apart or closer than in the item by this many words; from a hit to the next, by so many.
DRIFT, STEP = 8, 3

_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐]\s*\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+(?:[.,]\d+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[str]:
    """The words of text in lower case; a word broken by a hyphen at a line end is one."""
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.lower())


def _runs(words: list[str]) -> Iterator[tuple[str, ...]]:
    return zip(*(words[i:] for i in range(COPIED_RUN)))


class Unit:
    """A run of an item's words that is searched as a whole."""

    def __init__(self, words: list[str], rare: set[str]):
        self.size = len(words)
        self.words = words
        self.masks: dict[str, int] = {}
        for i, w in enumerate(words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        self.names = {w for w in words if w in rare and not w[0].isdigit()}
        self.figures = {w for w in words if w in rare and w[0].isdigit()}
        self.halves: list[Unit] = []
        if self.size >= 10:
            middle = self.size // 2
            self.halves = [Unit(words[:middle], rare), Unit(words[middle:], rare)]

    def lacks(self, text: set[str]) -> int:
        """Words of this unit that text has nowhere: it takes at least as many edits."""
        return sum(w not in text for w in self.words)

    def search(self, text: list[str]) -> tuple[int, int]:
        """(fewest edits, end) of the place in text where this unit fits best (Myers 1999, search form)."""
        m = self.size
        full, top = (1 << m) - 1, 1 << (m - 1)
        vp, vn, score, best, end, get = full, 0, m, m, 0, self.masks.get
        for j, word in enumerate(text, 1):
            eq = get(word, 0)
            x = eq | vn
            d0 = ((((x & vp) + vp) ^ vp) | x) & full
            hn, hp = vp & d0, (vn | ~(vp | d0)) & full
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
                if score < best:
                    best, end = score, j
            hp, hn = hp << 1, hn << 1
            vp, vn = (hn | ~(d0 | hp)) & full, d0 & hp & full
        return best, end


class Items:
    """A block of test items, indexed by pieces."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, [u for s in _SENTENCE.split(t or "") if (u := words_of(s))], words_of(t or "")) for i, t in items]
        #: words, and pairs of neighbours in a sentence -> number
        self.terms: dict[str | tuple[str, str], int] = {}
        self.runs: set[tuple[str, ...]] = set()
        for _, sentences, whole in self.items:
            for ws in sentences:
                for term in (*ws, *zip(ws, ws[1:])):
                    self.terms.setdefault(term, len(self.terms))
            for term in whole:
                self.terms.setdefault(term, len(self.terms))
            self.runs.update(_runs(whole))

    def index(self, documents_with: dict[int, int], documents: int) -> Items:
        """Ready for candidates() and leaked(): documents_with has the number of documents that hold each term outside copies."""
        limit, word_limit = max(LEAST_DOCUMENTS, RARE_PAIR_SHARE * documents), max(LEAST_DOCUMENTS, RARE_WORD_SHARE * documents)
        customary = {w for term, k in self.terms.items() if isinstance(term, tuple) and documents_with.get(k, 0) > limit for w in term}
        frequent = {term for term, k in self.terms.items() if isinstance(term, str) and documents_with.get(k, 0) > word_limit}
        self.ids, self.words, self.own, self.units, self.windows = [], [], [], [], []
        self.pieces: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)  # piece -> (item, position)
        self.holders: dict[str, list[int]] = defaultdict(list)  # own word -> items
        self.bare: set[int] = set()  # items with hardly a word of their own: only equal runs can tell
        for n, (item_id, sentences, ws) in enumerate(self.items):
            own = set(ws) - customary - frequent
            self.ids.append(item_id)
            self.words.append(ws)
            self.own.append(own)
            self.units.append([Unit(u, own) for u in sentences])
            self.windows.append({i: Unit(ws[i : i + WINDOW], own) for i in range(0, max(1, len(ws) - WINDOW + 1), PIECE)})
            for w in own:
                self.holders[w].append(n)
            if len(own) < 2:
                self.bare.add(n)
            for i in range(0, len(ws) - PIECE + 1, PIECE):
                self.pieces[tuple(ws[i : i + PIECE])].append((n, i))
        return self

    def _run(self, n: int, place: int, words: list[str], at: int) -> tuple[int, int]:
        """The part of item n around place that equals the words around words[at]: begin and end."""
        item, low, high = self.words[n], 0, 1
        while low < at and low < place and words[at - low - 1] == item[place - low - 1]:
            low += 1
        while at + high < len(words) and place + high < len(item) and words[at + high] == item[place + high]:
            high += 1
        return place - low, place + high

    def candidates(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Items of which a piece stands in words -> (place in words, place in item) of each hit.

        Items that verification would turn down at once are left out: those of whose own words none is in words."""
        holders, possible = self.holders.get, Counter()
        for w in set(words):
            if posted := holders(w):
                possible.update(posted)
        possible.update(self.bare)
        found: dict[int, list[tuple[int, int]]] = {}
        if possible:
            get = self.pieces.get
            for at, gram in enumerate(zip(*(words[i:] for i in range(PIECE)))):
                if posted := get(gram):
                    for n, place in posted:
                        if n in possible:
                            found.setdefault(n, []).append((at, place))
        return {n: hits for n, hits in found.items() if possible[n] >= 2 or any(b - a >= LONG_RUN for a, b in (self._run(n, p, words, at) for at, p in hits))}

    def leaked(self, n: int, words: list[str], hits: list[tuple[int, int]]) -> tuple[int, int, int, int, int]:
        """(words, names found, names there, figures found, figures there) of item n over its parts found in words; hits as of candidates()."""
        total = [0] * 5
        here = set(words)

        def take(unit: Unit) -> bool:
            if unit.lacks(here) > EDIT_SHARE * unit.size or not ((unit.names | unit.figures) & here):
                return False
            edits, end = unit.search(words)
            if edits <= EDIT_SHARE * unit.size:
                window = set(words[max(0, end - unit.size - edits) : end])
                names, figures = len(unit.names & window), len(unit.figures & window)
                whole = edits <= EDIT_SHARE / 2 * unit.size and unit.size >= LEAST_WORDS // 2
                if names + figures >= (1 if whole else 2) and names >= OWN_SHARE * len(unit.names):
                    for k, v in enumerate((unit.size - edits, names, len(unit.names), figures, len(unit.figures))):
                        total[k] += v
                    return True
            return False

        for unit in self.units[n]:
            if not take(unit):
                for half in unit.halves:
                    if not take(half):
                        for quarter in half.halves:
                            take(quarter)
        if is_leak(*total):
            return tuple(total)
        return max(tuple(total), self.excerpt(n, words, hits), key=lambda x: (is_leak(*x), x))

    def excerpt(self, n: int, words: list[str], hits: list[tuple[int, int]]) -> tuple[int, int, int, int, int]:
        """As leaked(), for the longest excerpt of item n that begins or ends within a sentence.

        Hits at about the same distance belong together. Windows around them are searched near their place, runs of equal
        words go on beyond the windows; between them count the words that stand near their place."""
        item, own, best = self.words[n], self.own[n], (0, 0, 0, 0, 0)
        figures = lambda ws: sum(w[0].isdigit() for w in ws)
        fits: dict[tuple[int, int], bool] = {}  # window, distance -> whether it stands there
        around: dict[tuple[int, int], set[int]] = {}  # hit -> places of the item that stand around it
        long_run = set()
        for at, place in hits:
            begin, end = self._run(n, place, words, at)
            if end - begin >= LONG_RUN:
                long_run.add((at, place))
            held, d = set(range(begin, end)), at - place
            for i in range(place - WINDOW + PIECE, place + 1, PIECE):
                if i in self.windows[n]:
                    if (i, d) not in fits:
                        region = words[max(0, i + d - STEP) : i + d + WINDOW + STEP]
                        window = self.windows[n][i]
                        fits[i, d] = window.lacks(set(region)) <= WINDOW_EDITS and window.search(region)[0] <= WINDOW_EDITS
                    if fits[i, d]:
                        held.update(j for j in range(i, min(i + WINDOW, len(item))) if item[j] in words[max(0, j + d - STEP) : j + d + STEP + 1])
            around[at, place] = held
        done = set()
        for shift in {at - place for at, place in hits}:
            near = frozenset(h for h in hits if abs(h[0] - h[1] - shift) <= DRIFT)
            if near in done:
                continue
            done.add(near)
            held = set().union(*(around[h] for h in near))
            if len({item[i] for i in held} & own) < 2 and not near & long_run:
                continue
            # from the own words held outwards, up to the first one that is not: beyond, another text goes on
            marks = sorted(i for i in held if item[i] in own) or sorted(held)
            missed = [i for i, w in enumerate(item) if w in own and i not in held]
            first = max((i + 1 for i in missed if i < marks[0]), default=0)
            last = min((i for i in missed if i > marks[-1]), default=len(item))
            kept = sorted(i for i in held if first <= i < last)
            if len(kept) > best[0]:
                inside = {w for w in item[kept[0] : kept[-1] + 1] if w in own}
                there = {item[i] for i in kept} & own
                best = (len(kept), len(there) - figures(there), len(inside) - figures(inside), figures(there), figures(inside))
        return best


def is_leak(words: int, names: int, of_names: int, figures: int, of_figures: int) -> bool:
    """Whether so many words make a leak: LEAST_WORDS with own names or figures, EXCERPT without."""
    return words >= (LEAST_WORDS if names + figures > 1 else EXCERPT) and names >= OWN_SHARE * of_names and figures >= OWN_SHARE * of_figures - 1


def _outside_copies(words: list[str], copied: list[int], terms: dict) -> set:
    """The terms in words, without those of the runs that begin at the places copied."""
    within = {j for i in copied for j in range(i, i + COPIED_RUN)}
    free = {w for j, w in enumerate(words) if j not in within}
    pairs = {p for j, p in enumerate(zip(words, words[1:])) if not (j in within and j + 1 in within)}
    return terms.keys() & (free | pairs)


def _term_counter(block: Items):
    """Partition of documents -> (term, number of documents that have it outside copies), for the words and pairs of the items."""
    terms, runs = block.terms, block.runs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        known = terms.keys()
        for batch in batches:
            for text in batch["text"]:
                words = words_of(text)
                copied = [i for i in range(0, len(words) - COPIED_RUN + 1, PIECE) if tuple(words[i : i + COPIED_RUN]) in runs]
                counts.update(_outside_copies(words, copied, terms) if copied else known & {*words, *zip(words, words[1:])})
        yield pd.DataFrame({"term": [terms[t] for t in counts], "n": list(counts.values())}, columns=["term", "n"])

    return run


def _matcher(block: Items):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if not text:
                    continue
                words = words_of(text)
                for n, hits in block.candidates(words).items():
                    if is_leak(*(got := block.leaked(n, words, hits))):
                        out.append((doc_id, block.ids[n], got[0]))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words"])

    return run


def find_leaks(documents: DataFrame, items: DataFrame, items_a_block: int = ITEMS_A_BLOCK) -> DataFrame:
    """(doc_id, item_id, n_words) for every document (doc_id, text) that repeats an item (item_id, text), or EXCERPT words of it.

    n_words: words of the item found, without edited ones. An item of fewer than LEAST_WORDS words leaks nowhere. Null and
    empty texts match nothing; repeated documents and items each come out. Order of items only sets the blocks.
    """
    documents = documents.select("doc_id", "text").filter("text IS NOT NULL")
    items = items.select("item_id", "text").filter("text IS NOT NULL")
    kind = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, n_words int"
    blocks, total = max(1, -(-items.count() // items_a_block)), documents.count()
    parts = []
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        block = Items([tuple(r) for r in part.collect()])  # about items_a_block
        counted = documents.select("text").mapInPandas(_term_counter(block), "term int, n int").groupBy("term").agg(F.sum("n").alias("n"))
        block.index({r.term: r.n for r in counted.collect()}, total)  # as many rows as the block has terms
        parts.append(documents.mapInPandas(_matcher(block), kind))
    return reduce(DataFrame.unionByName, parts)
