"""Sentence boundaries that know abbreviations, learnt from the corpus itself.

A period ends a sentence, an abbreviation, or both.  Which it is shows in the counts of a
corpus without any labels (Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary
Detection", 2006): an abbreviation is a short word that hardly ever stands without
its period, a sentence starter is a word that follows sentence ends more often than its
frequency explains, and a number with a period that is followed by the same few words is an
ordinal.  All three are log-likelihood ratios over one aggregate of word counts.

What is learnt is a table that grows with the corpus.  A kind with few words becomes a literal set, and
the cutting of a block stays an expression on its own row, without Python.  Of a kind with more, each
document gets the words that its own borders ask for by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivote.functions import text as T
from sentivote.operators.segment import SentenceSplitter, rule_pieces, token_array
from sentivote.session import checkpointed

#: Marks around a word that don't belong to it.
AROUND = "\"'«»“”„‚‘’()[]{},;:*_"
#: Stands for every number.
NUMBER = "#"
NUMERIC = r"^[0-9][0-9.,]*$"
#: How sure it is that an abbreviation is written with its period.
CERTAIN = 0.99
#: Least scores of an abbreviation, a sentence starter, a word that goes with a number.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
#: Learnt words of a kind that become literals; of more, documents get those they ask for.
MOST_WORDS = 20_000
#: The kinds of learnt words, as ``learn`` names them and as ``Boundaries`` does.
KINDS = {"abbreviation": "abbreviations", "starter": "starters", "ordinal": "ordinals"}

#: Column with the number of a document that was written once.
ROW = "_row"


def bare(token: Column) -> Column:
    return F.btrim(token, F.lit(AROUND))


def is_number(core: Column) -> Column:
    return T.begins_between(core, "0", "9") & core.rlike(NUMERIC)


def word_type(core: Column) -> Column:
    """A word in lower case without its last period; all numbers are one."""
    plain = F.when(core.endswith("."), F.substring(core, F.lit(1), F.length(core) - 1)).otherwise(core)
    return F.when(is_number(core), NUMBER).otherwise(F.lower(plain))


def written_words(text: Column) -> Column:
    """The words of a text.  Most texts hold no white space but blanks, and need no pattern to be cut."""
    cut = F.when(text.rlike(T.NOT_PLAIN), F.split(text, f"{T.WS}+")).otherwise(F.split(text, " "))
    return F.filter(cut, lambda t: t != "")


def word_counts(blocks: DataFrame, text_col: str = "text") -> DataFrame:
    """type, dot, follower, n: words of all blocks with and without a period, and the word behind a period.

    The follower is null behind words without a period, and at the end of a block.
    """
    tokens = written_words(F.col(text_col))

    def read(cores: Column) -> Column:
        def word(core: Column, i: Column) -> Column:
            dot = core.endswith(".")
            behind = F.nullif(word_type(F.get(cores, i + 1)), F.lit(""))
            return F.struct(word_type(core).alias("type"), dot.alias("dot"), F.when(dot, behind).alias("follower"))

        return F.transform(cores, word)

    words = blocks.select(F.inline(T.let(F.transform(tokens, bare), read)))
    return words.where("type <> ''").groupBy("type", "dot", "follower").agg(F.count(F.lit(1)).alias("n"))


def log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """Of k of n trials at probability p; what can't occur and doesn't counts nothing."""
    part = lambda times, chance: F.when(times == 0, 0.0).otherwise(times * F.log(chance))
    return part(k, p) + part(n - k, 1 - p)


def ratio(k: Column, breaks: Column, of_word: Column, total: Column) -> Column:
    """How much likelier it is that a word's share behind breaks (k of ``breaks``) differs from its share elsewhere."""
    behind, elsewhere, all_over = k / breaks, (of_word - k) / (total - breaks), of_word / total
    apart = log_likelihood(k, breaks, behind) + log_likelihood(of_word - k, total - breaks, elsewhere)
    alike = log_likelihood(k, breaks, all_over) + log_likelihood(of_word - k, total - breaks, all_over)
    return 2 * (apart - alike)


def abbreviation_score(dotted: Column, plain: Column, word: Column, share: Column) -> Column:
    """Likelihood of being an abbreviation, weighed by shortness, inner periods, and uses without a period.

    ``share`` is the share of all words that have a period.
    """
    n = dotted + plain
    evidence = 2 * (log_likelihood(dotted, n, F.lit(CERTAIN)) - log_likelihood(dotted, n, share))
    letters = F.length(F.replace(word, F.lit("."), F.lit(""))).cast("double")
    inner = F.length(word) - letters
    return evidence * F.exp(-letters) * (inner + 1) * F.pow(letters, -plain)


def learn(blocks: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, word, n, score: the abbreviations, sentence starters and followers of numbers of a corpus.

    ``n`` is how often the word has its period, or follows one.  Null blocks hold no words.
    """
    counts = checkpointed(word_counts(blocks, text_col))
    total, dotted = counts.agg(F.sum("n"), F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0))).first()
    total, dotted = F.lit(float(total or 1)), F.lit(float(dotted or 0))
    per_word = counts.groupBy("type").agg(
        F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)).alias("dotted"), F.sum("n").alias("n")
    )
    per_word = checkpointed(per_word)
    score = abbreviation_score(F.col("dotted"), F.col("n") - F.col("dotted"), F.col("type"), dotted / total)
    able = (F.col("dotted") > 0) & F.col("type").rlike(r"\p{L}")
    short = checkpointed(
        per_word.where(able).select(F.lit("abbreviation").alias("kind"), F.col("type").alias("word"), F.col("dotted").alias("n"), score.alias("score"))
        .where(F.col("score") >= ABBREVIATION)
    )
    # what follows the period of a word that is no abbreviation follows a sentence's end
    pairs = counts.where(F.col("follower").isNotNull())
    ends = pairs.join(short.select(F.col("word").alias("type")), "type", "left_anti")

    def standing_out(found: DataFrame, kind: str, least: float) -> DataFrame:
        """Followers that stand out in the rows (follower, n)."""
        breaks = F.lit(float(found.agg(F.sum("n")).first()[0] or 1))
        behind = found.groupBy("follower").agg(F.sum("n").cast("double").alias("k"))
        known = behind.join(per_word.select(F.col("type").alias("follower"), F.col("n").cast("double").alias("of_word")), "follower")
        rated = known.select(
            F.lit(kind).alias("kind"), F.col("follower").alias("word"), F.col("k").cast("long").alias("n"),
            ratio(F.col("k"), breaks, F.col("of_word"), total).alias("score"),
            (F.col("k") / breaks > F.col("of_word") / total).alias("more"),
        )
        return rated.where(F.col("more") & (F.col("score") >= least)).drop("more")

    starters = checkpointed(standing_out(ends.where(F.col("type") != NUMBER), "starter", STARTER))
    ordinals = standing_out(pairs.where(F.col("type") == NUMBER), "ordinal", COLLOCATION).where("n > 1")
    ordinals = ordinals.join(starters.select("word"), "word", "left_anti").select("kind", "word", "n", "score")
    return short.unionByName(starters).unionByName(ordinals)


@dataclass(frozen=True)
class Boundaries:
    """The words that decide whether a period ends a sentence: literals, or a column with an array of them."""

    abbreviations: Sequence[str] | Column = ()
    starters: Sequence[str] | Column = ()
    ordinals: Sequence[str] | Column = ()


def _few_words(learnt: DataFrame, kind: str, most: int) -> list[str] | None:
    """The words of a kind; nothing if there are more than ``most``."""
    words = [r["word"] for r in learnt.where(F.col("kind") == kind).select("word").limit(most + 1).collect()]
    return sorted(words) if len(words) <= most else None


def read_boundaries(learnt: DataFrame, most: int = MOST_WORDS) -> Boundaries:
    """The table of ``learn`` as literals.  More than ``most`` words of a kind are refused; ``with_learned`` takes any number."""
    found = {kind: _few_words(learnt, kind, most) for kind in KINDS}
    for kind, words in found.items():
        if words is None:
            raise ValueError(f"more than {most} words of the kind {kind} were learnt; give a larger number or learn by language")
    return Boundaries(**{KINDS[kind]: words for kind, words in found.items()})


def among(word: Column, words: Sequence[str] | Column) -> Column:
    if isinstance(words, Column):
        return F.array_contains(words, word)
    return word.isin(list(words)) if words else F.lit(False)


def first_letter(word: Column) -> tuple[Column, Column]:
    """Whether a word begins with an upper, and with a lower case letter."""
    first = F.substring(word, 1, 1)
    return first != F.lower(first), first != F.upper(first)


def runs_on(core: Column, follower: Column, known: Boundaries) -> Column:
    """Whether the period of the bare word ``core`` ends no sentence, given the bare word behind it, which few borders look at."""
    abbreviation = among(word_type(core), known.abbreviations)

    def decide(follower: Column) -> Column:
        upper, lower = first_letter(follower)
        starts = upper & among(word_type(follower), known.starters)
        ordinal = is_number(core) & (lower | among(word_type(follower), known.ordinals))
        return (abbreviation & ~starts) | ordinal

    return F.when(abbreviation | is_number(core), T.let(follower, decide)).otherwise(False)


def word_at(piece: Column, end: int) -> Column:
    """The last (``end`` -1) or the first word of a piece.

    What lies between its blanks is that word, unless it is empty or may hold other white space: a pattern of all
    white space is slow on a long piece.
    """
    pattern = rf"(?<!{T.NOT_WS}){T.NOT_WS}+\z" if end < 0 else rf"\A{T.NOT_WS}+"
    between = F.substring_index(F.rtrim(piece) if end < 0 else piece, " ", end)
    searched = F.regexp_extract(F.substring_index(T.strip(piece), " ", end), pattern, 0)
    return T.let(between, lambda word: F.when((word == "") | word.rlike(T.NOT_PLAIN), searched).otherwise(word))


def at_border(piece: Column, behind: Column, read: Callable[[Column, Column], Column], other: Column) -> Column:
    """``read`` of the bare words around the border between two pieces; ``other`` if there is no period before it."""
    both = lambda core: F.when(core.endswith("."), read(core, bare(word_at(behind, 1)))).otherwise(other)
    return F.when(behind.isNotNull(), T.let(bare(word_at(piece, -1)), both)).otherwise(other)


def splitter(known: Boundaries) -> SentenceSplitter:
    """A splitter for ``segment``: the rule's cuts without those behind abbreviations and ordinals."""

    def mark(pieces: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            end = lambda core, follower: F.when(runs_on(core, follower, known), "").otherwise("\n")
            return F.concat(piece, at_border(piece, F.get(pieces, i + 1), end, F.lit("\n")))

        return F.array_join(F.transform(pieces, one), "")

    def cut(block: Column) -> Column:
        return F.filter(F.split(T.let(rule_pieces(block), mark), "\n"), lambda p: p != "")

    return cut


def asked_words(text: Column, few: dict[str, Sequence[str] | None]) -> Column:
    """What the borders of a document ask of the kinds that are no literals: each word behind the first letter of its kind, once."""
    none = F.array().cast("array<string>")

    def words_of(core: Column, follower: Column) -> Column:
        upper, lower = first_letter(follower)
        abbreviation = F.lit(True) if few["abbreviation"] is None else among(word_type(core), few["abbreviation"])
        asked = {
            "abbreviation": F.when(~is_number(core), word_type(core)),
            "starter": F.when(abbreviation & upper, word_type(follower)),
            "ordinal": F.when(is_number(core) & ~lower, word_type(follower)),
        }
        return F.array(*[F.concat(F.lit(kind[0]), asked[kind]) for kind in KINDS if few[kind] is None])

    ask = lambda core, follower: T.let(follower, lambda f: words_of(core, f))

    def of_pieces(pieces: Column) -> Column:
        return F.flatten(F.transform(pieces, lambda piece, i: at_border(piece, F.get(pieces, i + 1), ask, none)))

    blocks = F.filter(token_array(text), lambda t: t["kind"] == "text")
    words = F.flatten(F.transform(blocks, lambda t: T.let(rule_pieces(t["text"]), of_pieces)))
    return F.array_distinct(F.array_compact(words))


def numbered(docs: DataFrame) -> DataFrame:
    """Documents written once, each with a number of its own in ``_row``."""
    return checkpointed(docs.withColumn(ROW, F.monotonically_increasing_id()))


def with_learned(docs: DataFrame, learnt: DataFrame, most: int = MOST_WORDS) -> tuple[DataFrame, SentenceSplitter]:
    """Documents and a splitter that cuts them by all words of ``learn``, however many there are.

    Kinds of up to ``most`` words are literals.  Of the others a document asks for the words at its own
    borders, and ``_known`` brings back those that were learnt.
    """
    learnt = checkpointed(learnt)
    few = {kind: _few_words(learnt, kind, most) for kind in KINDS}
    literals = {KINDS[kind]: words for kind, words in few.items() if words is not None}
    many = [kind for kind in KINDS if few[kind] is None]
    if not many:
        return docs.drop(ROW), splitter(Boundaries(**literals))
    kept = docs if ROW in docs.columns else numbered(docs)
    asked = kept.select(ROW, F.explode(asked_words(F.col("text"), few)).alias("asked"))
    met = asked.join(learnt.where(F.col("kind").isin(many)).select(F.concat(F.substring("kind", 1, 1), "word").alias("asked")), "asked")
    words = lambda kind: F.collect_list(F.when(F.col("asked").startswith(kind[0]), F.substring("asked", 2, 2**31 - 1)))
    answers = met.groupBy(ROW).agg(F.struct(*[words(kind).alias(KINDS[kind]) for kind in many]).alias("_known"))
    given = {KINDS[kind]: F.coalesce(F.col(f"_known.{KINDS[kind]}"), F.array().cast("array<string>")) for kind in many}
    return kept.join(answers, ROW, "left").drop(ROW), splitter(Boundaries(**literals, **given))


def learned_splitter(docs: DataFrame, blocks: DataFrame, text_col: str = "text") -> tuple[DataFrame, SentenceSplitter]:
    """Learn from all blocks of a corpus, for that corpus: ``with_learned`` of its documents."""
    return with_learned(docs, learn(blocks, text_col))
