"""Text functions: normal forms, tokens, similarities."""

from __future__ import annotations

import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def folded(text: str) -> str:
    """NFKC, lower case, ё as е."""
    return unicodedata.normalize("NFKC", text).lower().replace("ё", "е")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def fold(text: Column) -> Column:
    """Lower case, ё as е; for text that is NFKC already."""
    return F.translate(F.lower(text), "ё", "е")


def normal(text: Column) -> Column:
    """Folded words of letters and digits with single spaces."""
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))


def words(text: Column, least: int = 1, stop: tuple[str, ...] = ()) -> Column:
    """Distinct words of a normal text, without short ones, numbers and stop words."""
    each = F.split(normal(text), " ")
    return F.array_distinct(F.filter(each, lambda w: (F.length(w) >= least) & ~w.rlike(r"^\d*$") & ~w.isin(*stop) if stop else (F.length(w) >= least) & ~w.rlike(r"^\d*$")))


#: Words that say what kind of thing an event is, not which.
GENERIC_WORDS = [
    "анонс", "встреча", "действия", "мероприятие", "событие", "концерт", "вечеринка", "туса", "тусовка", "воронеж", "воронеже", "город", "бар", "club", "клуб", "hall", "rock",
    "авторы", "автор", "новые", "сообщения", "поддержке", "двери", "билеты", "вход", "начало", "старт", "пройдет", "состоится",
]
#: Words that do not count.
STOP_WORDS = [
    "а", "без", "бы", "в", "вам", "вас", "весь", "во", "вот", "все", "всех", "вы", "где", "для", "до", "его", "ее", "ещё", "же", "за", "и", "из", "или", "им", "их", "к", "как", "когда", "кто", "мы", "на", "над", "нас", "не", "но",
    "о", "об", "от", "по", "под", "при", "про", "с", "со", "так", "там", "то", "у", "уже", "что", "это", "этот", "эта", "этом", "будет", "будут", "можно", "наш", "наша", "ваш", "ваша", "свой", "свои", "самый", "самая", "очень",
]


def tokens(text: Column, generic: bool = True) -> Column:
    """Distinct words of 2 letters or more without stop words and, unless asked for, generic ones; links do not count."""
    gone = STOP_WORDS if generic else STOP_WORDS + GENERIC_WORDS
    each = F.split(normal(F.regexp_replace(text, r"https?://\S+", " ")), " ")
    return F.array_distinct(F.filter(each, lambda w: (F.length(w) >= 2) & ~w.isin(*gone)))


def translit(text: Column) -> Column:
    """Cyrillic to Latin, lower case."""
    out = F.translate(F.lower(text), "абвгдеёзийклмнопрстуфыэ", "abvgdeezijklmnoprstufye")
    for a, b in (("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"), ("ъ", ""), ("ь", ""), ("ю", "yu"), ("я", "ya")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))


def char_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; a shorter text of 4 or more that the longer holds counts as min(1, ratio + 0.35)."""
    short, long_ = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    most = F.greatest(F.length(a), F.length(b))
    return (
        F.when((most == 0) | (F.length(short) == 0), 0.0)
        .when(a == b, 1.0)
        .when((F.length(short) >= 4) & F.contains(long_, short), F.least(F.lit(1.0), _ratio(a, b) + 0.35))
        .otherwise(1 - F.levenshtein(a, b) / most)
    )


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def token_similarity(a: Column, b: Column) -> Column:
    j, c = jaccard(a, b), overlap(a, b)
    return F.greatest(j, 0.58 * j + 0.42 * c)


def grams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def gram_dice(a: Column, b: Column, n: int = 3) -> Column:
    x, y = grams(a, n), grams(b, n)
    return F.when((F.length(a) < n) | (F.length(b) < n), (a == b).cast("double")).otherwise(2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def text_similarity(a: Column, b: Column) -> Column:
    """Of normal texts: 1 if equal, at least 0.82 if one of 8 or more is inside the other, else by tokens and trigrams."""
    short, long_ = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    tokens = token_similarity(F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " ")))
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .when((F.length(short) >= 8) & F.contains(long_, short), F.greatest(F.lit(0.82), _ratio(a, b)))
        .otherwise(F.greatest(tokens, 0.68 * tokens + 0.32 * gram_dice(a, b)))
    )


def time_similarity(a: Column, b: Column) -> Column:
    """Of minutes of the day: tiers by distance, 0.62 if both are unknown, 0.56 if one is."""
    apart = F.abs(a - b)
    return (
        F.when(a.isNull() & b.isNull(), 0.62).when(a.isNull() | b.isNull(), 0.56).when(apart == 0, 1.0)
        .when(apart <= 15, 0.92).when(apart <= 30, 0.76).when(apart <= 60, 0.38).otherwise(0.0)
    )


def field_similarity(a: Column, b: Column) -> Column:
    """Text similarity, neutral where a side is empty: 0.48 both, 0.54 one."""
    return F.when((a == "") & (b == ""), 0.48).when((a == "") | (b == ""), 0.54).otherwise(text_similarity(a, b))


def observed_similarity(a: Column, b: Column) -> Column:
    """Of epoch seconds: tiers at 5 minutes, 1, 6 and 24 hours."""
    apart = F.abs(a - b)
    return F.when(apart <= 300, 1.0).when(apart <= 3600, 0.9).when(apart <= 21600, 0.6).when(apart <= 86400, 0.35).otherwise(0.0)


def canonical_url(url: Column) -> Column:
    """Without query, fragment and closing slashes; scheme and host in lower case."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    host = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    return F.regexp_replace(F.concat(F.lower(host), F.substr(bare, F.length(host) + 1)), r"/+$", "")


def content_hash(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def plain_name(name: Column, default: str = "?") -> Column:
    """A name for display: no links or markup, at most 60 characters."""
    bare = F.regexp_replace(F.regexp_replace(name, r"https?://\S+", " "), r"[\[\]|<>*_`@]+", " ")
    bare = F.substring(F.trim(F.regexp_replace(bare, r"\s+", " ")), 1, 60)
    return F.when(F.coalesce(bare, F.lit("")) == "", default).otherwise(bare)


# -- without a built-in, or much faster in Arrow batches


class PairSimilarity:
    """`text_similarity`, `token_similarity` and common words of two texts, as the columns above have them, in plain Python.

    Words and trigrams of texts are kept, and so are the values of pairs, as most texts come again; `trim` bounds them.
    """

    #: Texts and pairs that a worker remembers from one batch to the next.
    KEPT = 1 << 15

    def __init__(self):
        self.words: dict[str, frozenset[str]] = {}
        self.grams: dict[str, frozenset[str]] = {}
        self.texts: dict[tuple[str, str], float] = {}
        self.lists: dict[tuple[str, str], float] = {}

    def trim(self) -> PairSimilarity:
        for held in (self.words, self.grams, self.texts, self.lists):
            if len(held) > self.KEPT:
                held.clear()
        return self

    def split(self, text: str) -> frozenset[str]:
        found = self.words.get(text)
        if found is None:
            found = self.words[text] = frozenset(text.split(" ")) if text else frozenset()
        return found

    def trigrams(self, text: str) -> frozenset[str]:
        found = self.grams.get(text)
        if found is None:
            found = self.grams[text] = frozenset(text[i : i + 3] for i in range(max(len(text) - 2, 1)))
        return found

    def tokens(self, a: str, b: str) -> float:
        """token_similarity of words with single spaces."""
        found = self.lists.get((a, b))
        if found is None:
            x, y = self.split(a), self.split(b)
            both = len(x & y)
            j = both / (len(x) + len(y) - both) if both else 0.0
            found = self.lists[a, b] = max(j, 0.58 * j + 0.42 * (both / min(len(x), len(y)))) if both else 0.0
        return found

    def text(self, a: str, b: str) -> float:
        if a == "" or b == "":
            return 0.0
        if a == b:
            return 1.0
        found = self.texts.get((a, b))
        if found is None:
            short, long_ = (a, b) if len(a) <= len(b) else (b, a)
            if len(short) >= 8 and short in long_:
                found = max(0.82, len(short) / len(long_))
            else:
                tokens = self.tokens(a, b)
                dice = 0.0
                if len(short) >= 3:
                    x, y = self.trigrams(a), self.trigrams(b)
                    dice = 2 * len(x & y) / (len(x) + len(y))
                found = max(tokens, 0.68 * tokens + 0.32 * dice)
            self.texts[a, b] = found
        return found


_similarity = PairSimilarity()


def similarity_udf(schema: str, texts: int, tokens: int, counts: int):
    """A function of 2 * texts normal texts, 2 * tokens and 2 * counts lists of words (joined by spaces), a pair beside a pair.

    It gives, in the order of schema, each pair's text similarity, each pair's token similarity, and of the last how many words both have.
    """

    @F.pandas_udf(schema)
    def run(*columns: pd.Series) -> pd.DataFrame:
        of, out = _similarity.trim(), []
        for i in range(texts + tokens + counts):
            x, y = columns[2 * i], columns[2 * i + 1]
            if i < texts:
                out.append([of.text(a, b) for a, b in zip(x, y)])
            elif i < texts + tokens:
                out.append([of.tokens(a, b) for a, b in zip(x, y)])
            else:
                out.append([len(of.split(a) & of.split(b)) for a, b in zip(x, y)])
        return pd.DataFrame(dict(zip((c.split()[0] for c in schema.split(",")), out)))

    # Not to be moved into conditions on its values and repeated there.
    return run.asNondeterministic()


def _jaro(a: str, b: str) -> float:
    if a == b:
        return float(bool(a))
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    right = [c for c, f in zip(b, free) if not f]
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity, with at most 4 common first letters at 0.1 each."""

    def one(x: str, y: str) -> float:
        j, n = _jaro(x, y), 0
        while n < min(4, len(x), len(y)) and x[n] == y[n]:
            n += 1
        return j + 0.1 * n * (1 - j)

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def multiset_dice(a: pd.Series, b: pd.Series) -> pd.Series:
    """Dice coefficient of trigram multisets (texts shorter than 3 are one gram)."""

    def counts(t: str) -> Counter:
        return Counter(t[i : i + 3] for i in range(len(t) - 2)) if len(t) > 2 else Counter([t] if t else [])

    def one(x: str, y: str) -> float:
        p, q = counts(x), counts(y)
        total = sum(p.values()) + sum(q.values())
        return 2 * sum((p & q).values()) / total if total else 0.0

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b)])


def in_order(x: list[str], y: list[str]) -> float:
    """Longest common subsequence over the longer number of words."""
    row = [0] * (len(y) + 1)
    for w in x:
        last = 0
        for j, v in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if w == v else max(row[j], row[j - 1])
    return row[-1] / max(len(x), len(y)) if x and y else 0.0


@F.pandas_udf(DoubleType())
def ordered_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence of words over the longer number of words."""
    return pd.Series([None if x is None or y is None else in_order(x.split(), y.split()) for x, y in zip(a, b)])
