"""Mapping free-entered values to a canonical list, with unmatched values reported.

A BK-tree holds the stems of the list (see names.py) under Levenshtein's distance, a true metric; for every distinct
typed value it returns all entries within the threshold, pruned by the triangle inequality. Of those, an entry counts
if it bears the same number (type 2 is not type 3) and no class word contradicts it; the nearest wins. A list of more
than SHARD_ROWS entries is split into shards by hash: each shard's tree is broadcast in its turn, and the winners of
the shards are merged by distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.names import Lexicon, learn_lexicon, lexicon, parse_names
from lattiq.llm.strings import BKTree

SHARD_ROWS = 50_000
#: Edits allowed in a stem, and characters of a stem for each edit.
MOST_EDITS, CHARACTERS_AN_EDIT = 4, 2.5
#: From this many edits on, the class words of the value must all be among those of the entry.
CHECKED_FROM = 2


def _search(entries: list[tuple], lex: Lexicon, threshold: int):
    """A function for mapInPandas: name -> (name, entry_id, edits) of the best entry of this shard."""
    by_stem: dict[str, list[tuple]] = {}
    for entry in entries:
        by_stem.setdefault(entry[1], []).append(entry)
    tree, key = BKTree([s for s in by_stem if s]), lex.key

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [lexicon(key).parse(n) for n in batch["name"]]
            stems = sorted({p.stem for p in parsed if p.stem})
            near: dict[str, list[tuple[int, str]]] = {}
            for q, node, d in zip(*(x.tolist() for x in tree.within(stems, threshold))):
                if d <= len(stems[q]) / CHARACTERS_AN_EDIT:
                    near.setdefault(stems[q], []).append((d, tree.nodes.texts[node]))
            out = []
            for name, p in zip(batch["name"], parsed):
                fits = [
                    (d, len(p.words ^ entry_words), entry_id)
                    for d, stem in near.get(p.stem, ())
                    for entry_id, _, entry_words, number in by_stem[stem]
                    if number == p.number and (d < CHECKED_FROM or p.words <= entry_words)
                ]
                if fits:
                    d, differ, entry_id = min(fits)
                    out.append((name, entry_id, d * 100 + differ))
            yield pd.DataFrame(out, columns=["name", "entry_id", "cost"])

    return run


def map_to_list(names: DataFrame, entries: DataFrame, unmatched: str = "UNMATCHED", threshold: int = MOST_EDITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(name, entry_id) of the nearest entry for every row of names (name); entry_id is unmatched where there is none.

    names should be distinct (each row costs a search). entries: (entry_id, name). A null name gives no row, an empty one
    or one without a stem is unmatched; entries with a null name, or equal in stem, class words and number, do no harm:
    the smallest id wins a tie. An empty list leaves every name unmatched.
    """
    parallel = names.sparkSession.sparkContext.defaultParallelism
    # few names make one small file and thus one task; each name is a search, so they are spread
    names, entries = names.select("name").filter("name IS NOT NULL").repartition(4 * parallel, "name"), entries.select("entry_id", "name").filter("name IS NOT NULL")
    lex = learn_lexicon(entries.select("name"), typed=names)
    parsed = parse_names(entries, lex).select("entry_id", "stem", "words", "number")
    shards = max(1, -(-entries.count() // shard_rows))
    winners = []
    for shard in range(shards):
        part = parsed if shards == 1 else parsed.filter(F.pmod(F.xxhash64("stem"), F.lit(shards)) == shard)
        rows = [(r.entry_id, r.stem, frozenset(r.words.split()), r.number) for r in part.collect()]  # about shard_rows
        winners.append(names.mapInPandas(_search(rows, lex, threshold), "name string, entry_id string, cost int"))
    best = winners[0] if shards == 1 else reduce(DataFrame.unionByName, winners).groupBy("name").agg(F.min_by("entry_id", F.struct("cost", "entry_id")).alias("entry_id"))
    return names.join(best.select("name", "entry_id"), "name", "left").select("name", F.coalesce("entry_id", F.lit(unmatched)).alias("entry_id"))
