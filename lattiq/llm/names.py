"""Names typed in many ways: folded, cleaned of wrappings, and taken apart into stem, class words and number.

Nothing about the words is given; they are learned from the names:
* class words (leukemia, kinase, chronic ...) are those that many names of a reference list share;
* frame words (suspected, nos, hx, human ...) wrap a name without belonging to it: frequent words of typed names that
  the list does not use and that are not the rarest word of their name, or, without a list, words without which the
  rest of the name mostly is a name of its own;
* acronyms stand for class words that often follow each other; variants are frequent ways to write a class word.
Everything else that is no number is the stem, the part that tells two things apart.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.plans.lineage import written

# Roman numerals up to ten.
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
#: Share of a frame word's names in which it must stand beside a rarer word; share of them whose rest must be a name.
FRAMES_RARER_WORD, FRAMES_REST_IS_NAME = 0.8, 0.25
#: Words whose meaning a lexicon remembers.
MOST_TOKENS = 20_000
#: Least share of all typed names for a frame word.
FRAME_SHARE = 0.0005

_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z][a-z]{2})")
_WORD = re.compile(r"[^\W_]+\.?")
_CONSONANTS = re.compile(r"(?<=[aeiouy])[^aeiouy\W\d_]{3,4}$")
_TYPED = re.compile(r"(?:t|typ|type)?(\d+)")


def fold(text: str) -> str:
    """text without accents and letter case; camel case and joined marks become blanks."""
    text = _CAMEL.sub(" ", text) if not text.isupper() else text
    plain = unicodedata.normalize("NFKD", text)
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


def _edits(a: str, b: str, most: int) -> int:
    if abs(len(a) - len(b)) > most:
        return most + 1
    previous = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (x != y)))
        if min(row) > most:
            return most + 1
        previous = row
    return previous[-1]


def _is_subsequence(short: str, word: str) -> bool:
    rest = iter(word)
    return all(c in rest for c in short)


def _whole_words(words: set[str]) -> frozenset[str]:
    """words without those that are short forms of others."""
    short = lambda w: any(len(v) > len(w) and v[0] == w[0] and len(w) <= 0.7 * len(v) and _is_subsequence(w, v) for v in words)
    return frozenset(w for w in words if len(w) > 6 or not short(w))


@dataclass(frozen=True)
class Parsed:
    stem: str
    words: frozenset[str]
    number: int  # 0: none


@dataclass
class Lexicon:
    """What is known of the words; made by learn() or learn_lexicon() from names, or given."""

    words: frozenset[str]
    frames: frozenset[str] = frozenset()
    acronyms: tuple[tuple[str, tuple[str, ...]], ...] = ()
    variants: frozenset[str] = frozenset()
    _memo: dict = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self):
        self._acronyms = dict(self.acronyms)
        self._tokens: dict[tuple[str, bool], tuple[str, ...] | None] = {}
        self._letters = {w: frozenset(w) for w in self.words}

    @classmethod
    def learn(cls, names, least: float = 0.005, at_least: int = 3) -> Lexicon:
        """Class words of names: letters only, and in at least that share (and number) of the distinct stripped names."""
        distinct = {fold(n) for n in names if n}
        counts = Counter(w for n in distinct for w in {x.rstrip(".") for x in _WORD.findall(n)})
        limit = max(at_least, least * len(distinct))
        return cls(_whole_words({w for w, n in counts.items() if n >= limit and len(w) > 2 and w.isalpha()}))

    @property
    def key(self) -> tuple:
        return self.words, self.frames, self.acronyms, self.variants

    def _class_words(self, token: str, short: bool) -> tuple[str, ...] | None:
        """The class words that token stands for, each as the shortest one of its family (transport for transporter)."""
        if (at := (token, short)) in self._tokens:
            return self._tokens[at]
        if len(self._tokens) >= MOST_TOKENS:
            self._tokens.clear()
        got = self._tokens[at] = self._shortest(token, short)
        return got

    def _shortest(self, token: str, short: bool) -> tuple[str, ...] | None:
        found = self._written(token, short)
        return found and tuple(min((v for v in self.words if len(v) > 5 and w.startswith(v)), key=len, default=w) for w in found)

    def _written(self, token: str, short: bool) -> tuple[str, ...] | None:
        """The class words that token is a way to write; short: a full stop follows, or it is as short as an abbreviation."""
        if token in self.words:
            return (token,)
        if token in self._acronyms:
            return self._acronyms[token]
        if both := next(((token[:i], token[i:]) for i in range(3, len(token) - 2) if token[:i] in self.words and token[i:] in self.words), None):
            return both
        if short and len(token) > 1:
            if len(token) > 2 and (starts := [w for w in self.words if w.startswith(token)]):
                return (min(starts),) if len(starts) == 1 else tuple(sorted(starts)[:1])
            if inside := [w for w in self.words if w[0] == token[0] and len(token) <= 0.7 * len(w) and _is_subsequence(token, w)]:
                return (min(inside, key=lambda w: (len(w), w)),)
        if len(token) >= 5:
            most = lambda w: 2 if max(len(w), len(token)) > 6 else 1
            # each edit changes at most one letter, so words with more other letters are too far
            own = frozenset(token)
            close = (w for w in self.words if len(w) >= 5 and len(own - self._letters[w]) <= most(w) and len(self._letters[w] - own) <= most(w))
            near = [(d, w) for w in close if (d := _edits(token, w, most(w))) <= most(w)]
            if near:
                return (min(near)[1],)
        return None

    def _unglued(self, token: str, short: bool) -> tuple[str, list[str]]:
        """token without class words and wrappings that were written without a blank, and those class words.

        short: a full stop follows, so that the end of token may be an abbreviation."""
        out, again = [], True
        for w in self._long_frames:
            if token.startswith(w) and len(token) >= len(w) + 6:
                token = token[len(w) :]
            if token.endswith(w) and len(token) >= len(w) + 6:
                token = token[: -len(w)]
        if short:
            for n in range(min(8, len(token) - 6), 2, -1):
                if starts := sorted(w for w in self.words if len(w) > n and w.startswith(token[-n:])):
                    token, out = token[:-n], starts[:1]
                    break
        elif tail := _CONSONANTS.search(token):
            if inside := [w for w in self.words if w[0] == tail.group()[0] and len(w) > 5 and _is_subsequence(tail.group(), w)]:
                token, out = token[: tail.start()], [min(inside, key=lambda w: (len(w), w))]
        while again:
            again = False
            for w, meant in self._glue:
                rest = token[: -len(w)] if token.endswith(w) else token[len(w) :] if token.startswith(w) else None
                if rest is not None and (len(rest) >= 4 or not rest):
                    token, again = rest, bool(rest)
                    out.append(meant)
                    break
        return token, out

    @property
    def _glue(self) -> list[tuple[str, str]]:
        """What may be written together with a stem, longest first."""
        if (got := self._memo.get(_glue_key := ("glue",))) is None:
            words = [(w, w) for w in self.words if len(w) >= 4] + [(w, m[0]) for w in self.variants if len(w) >= 5 and (m := self._written(w, False))] + [("type", "type")]
            got = self._memo[_glue_key] = sorted(words, key=lambda x: (-len(x[0]), x))
        return got

    @property
    def _long_frames(self) -> list[str]:
        if (got := self._memo.get(_key := ("frames",))) is None:
            got = self._memo[_key] = sorted((w for w in self.frames if len(w) > 2), key=lambda w: (-len(w), w))
        return got

    def _is_frame(self, token: str) -> bool:
        """Whether token is a frame word, or two that were written together."""
        return token in self.frames or any(token[:i] in self.frames and token[i:] in self.frames for i in range(2, len(token) - 1))

    def parse(self, name: str | None) -> Parsed:
        """Stem, class words and number of name; null and blank names have an empty stem."""
        if not name:
            return Parsed("", frozenset(), 0)
        return self._parse(name)

    def _parse(self, name: str) -> Parsed:
        stem, words, number = [], set(), 0
        # "B, A" stands for "A B"
        before, comma, after = fold(name).partition(",")
        for raw in _WORD.findall(f"{after} {before}" if comma else before):
            token = raw.rstrip(".")
            if typed := _TYPED.fullmatch(token):
                number = int(typed.group(1)[:9])
            elif token in ROMAN:
                number = ROMAN[token]
            elif token in ("type", "typ") or self._is_frame(token):
                continue
            elif (found := self._class_words(token, raw.endswith(".") or len(token) <= 8)) is not None:
                words.update(found)
            else:
                rest, glued = self._unglued(token, raw.endswith("."))
                words.update(w for g in glued for w in self._class_words(g, False) or ())
                stem.append(rest)
        words.discard("type")
        return Parsed("".join(stem), frozenset(words), number)


def _tokens(names: DataFrame, column: str = "name") -> DataFrame:
    """Distinct (n, w): folded names, and the array of their words."""
    folded = names.select(F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}]+", " ")).alias("n")).filter("n <> ''").distinct()
    return folded.withColumn("w", F.split("n", " "))


def learn_lexicon(names: DataFrame, least: float = 0.005, at_least: int = 3, typed: DataFrame | None = None) -> Lexicon:
    """A lexicon of columns "name" of any size; only words above the share reach the driver.

    Those are at most 1 / least (1 / FRAME_SHARE for frames) times the mean number of words in a name. names: the
    reference list; typed: names typed freely for its entries. Without typed, names are both. Counts and shares are over all distinct names."""
    listed = written(_tokens(names))
    total = listed.count()
    counted = lambda df: df.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    limit = max(at_least, least * total)
    often = {r.w for r in counted(listed).filter(F.col("c") >= limit).collect()}
    words = _whole_words({w for w in often if len(w) > 2 and w.isascii() and w.isalpha()})
    follow = listed.select(F.explode(F.expr("transform(sequence(1, greatest(size(w) - 1, 1)), i -> struct(w[i - 1] AS a, get(w, i) AS b))")).alias("p")).select("p.a", "p.b")
    pairs = follow.filter(F.col("a").isin(list(words)) & F.col("b").isin(list(words))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= limit).collect() if words else []
    acronyms: dict[str, tuple[str, ...]] = {}
    for r in sorted(pairs, key=lambda r: (-r.c, r.a, r.b)):
        acronyms.setdefault(r.a[0] + r.b[0], (r.a, r.b))
    lexicon = Lexicon(words, frozenset(), tuple(sorted(acronyms.items())))
    if typed is None:
        # a word is a frame if the rest of its names mostly is a name of its own
        w = F.explode(F.array_distinct(F.filter("w", lambda x: x.isin(list(words))))) if words else F.lit(None).cast("string")
        rests = listed.select(w.alias("f"), "w").filter("f IS NOT NULL").withColumn("n", F.array_join(F.filter("w", lambda x: x != F.col("f")), " "))
        held = rests.join(listed.select("n", F.lit(1).alias("held")), "n", "left").groupBy("f").agg(F.avg(F.coalesce("held", F.lit(0))).alias("share"))
        frames = {r.f for r in held.filter(F.col("share") >= FRAMES_REST_IS_NAME).collect()}
        words = _whole_words(set(words) - frames)
        known = Lexicon(words)
        written_often = counted(listed).filter((F.col("c") >= max(at_least, FRAME_SHARE * total)) & (F.length("w") >= 5)).collect()
        variants = frozenset(r.w for r in written_often if r.w not in words and r.w not in frames and known._written(r.w, False))
        return Lexicon(words, frozenset(frames), lexicon.acronyms, variants)
    tokens = written(_tokens(typed))
    many = max(at_least, FRAME_SHARE * tokens.count())
    counts = written(counted(tokens))
    per = tokens.select("n", F.explode(F.array_distinct("w")).alias("w")).join(counts, "w")
    least_of = per.groupBy("n").agg(F.min("c").alias("least"))
    # what stands beside a rarer word is no stem
    beside = per.filter(F.col("c") >= many).join(least_of, "n").groupBy("w").agg(F.avg((F.col("c") > 2 * F.col("least")).cast("double")).alias("share"))
    frequent = {r.w for r in beside.filter(F.col("share") >= FRAMES_RARER_WORD).collect()} - words - set(ROMAN)
    variants = {w for w in frequent if lexicon._written(w, len(w) <= 8)}
    return Lexicon(words, frozenset(frequent - variants - set(acronyms)), lexicon.acronyms, frozenset(variants))


def parse_names(names: DataFrame, lex: Lexicon) -> DataFrame:
    """names with stem, words (sorted, blank between) and number of their column "name"."""
    key = lex.key

    def parse(column: pd.Series) -> pd.DataFrame:
        parsed = [lexicon(key).parse(n) for n in column]
        return pd.DataFrame({"stem": [p.stem for p in parsed], "words": [" ".join(sorted(p.words)) for p in parsed], "number": [p.number for p in parsed]})

    kind = T.StructType([T.StructField("stem", T.StringType()), T.StructField("words", T.StringType()), T.StructField("number", T.LongType())])
    # called non-deterministic so that the optimizer does not repeat it for each field and filter
    return names.withColumn("__p", F.pandas_udf(parse, kind).asNondeterministic()(F.col("name"))).select(*names.columns, "__p.stem", "__p.words", "__p.number")


@lru_cache(maxsize=2)
def lexicon(key: tuple) -> Lexicon:
    """One lexicon, with what it remembers, for each set of known words in a worker."""
    return Lexicon(*key)
