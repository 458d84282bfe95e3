"""Text expressions: cleaning, sentences, packing, questions. All stay in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import col

#: Patterns that mark where questions and answers begin.
FIRST_QUESTION = r"My (first )?question .*"
INVITATION = r"(I am[\w\s,]{10,30}questions\.)|(We[\w\s,]*questions[\w\s]*\.)|(\s?Click here [\w\s,]*answers\.)"
TRANSCRIPT_HEAD = r"Transcript of the questions.*ECB"
TRANSCRIPT_SKIP = r"(?i)Transcript of the questions.*President(of the ECB)?"

#: Signs around words, and those that may follow a sentence's last sign.
SIGNS, CLOSERS = ".,;:!?\"'()[]{}<>«»„“”‘’…–—|-", "\"')]}>»”’"
#: White space after a sentence's last sign, in three parts for Java and RE2 alike.
MAYBE_END = r"([.!?][" + "\"')\\]}>»”’" + r"]*)(\s+)"
CUT = "\u0001"


def squeeze(text) -> Column:
    """White space at the ends removed, runs of it made one space. Single spaces, which are nearly all, aren't replaced."""
    return F.trim(F.regexp_replace(col(text), r"[^\S ]\s*| \s+", " "))


def clean_paragraph(text, limit: int = 100) -> Column:
    """Squeezed text; empty if null or shorter than ``limit``."""
    t = squeeze(text)
    return F.coalesce(F.when(F.length(t) >= limit, t), F.lit(""))


def bare(word) -> Column:
    return F.rtrim(col(word), F.lit(CLOSERS))


def word_type(word) -> Column:
    """The word in lower case, without signs around it."""
    return F.lower(F.btrim(col(word), F.lit(SIGNS)))


def dotted(word) -> Column:
    """Ends with one dot."""
    b = bare(word)
    return b.endswith(".") & ~b.endswith("..")


def ends_sentence(word) -> Column:
    return F.right(bare(word), F.lit(1)).isin(".", "!", "?")


def _first(word) -> Column:
    return F.ltrim(col(word), F.lit(SIGNS))


def starts_upper(word) -> Column:
    return _first(word).rlike(r"^\p{Lu}")


def starts_lower(word) -> Column:
    return _first(word).rlike(r"^\p{Ll}")


def has_letter(word) -> Column:
    return col(word).rlike(r"\p{L}")


def after_hyphen(word) -> Column:
    return F.substring_index(col(word), "-", -1)


def kind_of(word, known: Column) -> Column:
    """abbreviation, initial, number or word, of the type of a dotted word; ``known``: it, or what follows its last hyphen, is
    an abbreviation."""
    w = col(word)
    return F.when(F.length(w) == 1, F.when(has_letter(w), "initial").otherwise("number")).when(~has_letter(w), "number").when(known, "abbreviation").otherwise("word")


def first_word(text) -> Column:
    return F.regexp_extract(col(text), r"^\s*(\S+)", 1)


def ends_between(kind, b, up, low, together, starter, opener) -> Column:
    """Whether a sentence ends after a word of a kind, before one of type b that starts with a capital (up) or a small letter
    (low); whether both are a collocation and the second one is a starter or an opener."""
    starts = up & starter
    return (
        F.when(kind.isin("word", "sign"), True)
        .when(kind == "dots", up)
        .when(together, False)
        .when(kind == "abbreviation", starts | (up & opener))
        .when(kind == "initial", starts | ~has_letter(b))
        .otherwise(~low)
    )


def _told(pieces: Column, kind_of_dotted) -> Column:
    """Of pieces of a text what matters where it is cut: the last word's type and its kind. Each step is a transform of
    its own, so that nothing is worked out twice."""

    def last_word(p):
        for sign in " \n\t\r\f":
            p = F.substring_index(p, sign, -1)
        return p

    bared = F.transform(F.transform(pieces, last_word), lambda w: F.struct(word_type(w).alias("a"), bare(w).alias("e")))
    kind = lambda x: F.when(~x["e"].endswith("."), "sign").when(x["e"].endswith(".."), "dots").otherwise(kind_of_dotted(x["a"]))
    return F.transform(bared, lambda x: F.struct(x["a"].alias("a"), kind(x).alias("kind")))


@dataclass(frozen=True)
class Boundaries:
    """What tells dots of sentences from others: see operators.boundaries, which learns it. Without anything learned,
    initials and numbers before a small letter are all that is known."""

    abbreviations: frozenset[str] = frozenset()
    starters: frozenset[str] = frozenset()
    collocations: frozenset[str] = frozenset()
    openers: frozenset[str] = frozenset()

    def kind(self, word) -> Column:
        """abbreviation, initial, number or word, of the type of a dotted word."""
        w = col(word)
        return kind_of(w, _in(w, self.abbreviations) | _in(after_hyphen(w), self.abbreviations))

    def told(self, pieces: Column) -> Column:
        return _told(pieces, self.kind)

    def ends(self, before, after) -> Column:
        """Whether a sentence ends between a told piece and the next one. Only of few kinds the next word is looked at."""
        first = first_word(after)
        b = word_type(first)
        return ends_between(before["kind"], b, starts_upper(first), starts_lower(first), _in(F.concat_ws(" ", before["a"], b), self.collocations), _in(b, self.starters), _in(b, self.openers))


def _in(x: Column, names: frozenset[str]) -> Column:
    return x.isin(*sorted(names)) if names else F.lit(False)


def _bind(value: Column, f) -> Column:
    """f(value), where value is worked out once, whatever f makes of it."""
    return F.get(F.transform(F.array(value), f), 0)


def _pieces(text) -> Column:
    """A text cut at every place where a sentence may end; white space there begins the next piece."""
    return F.split(F.regexp_replace(text, MAYBE_END, "$1" + CUT + "$2"), CUT)


def _cut(joined: Column) -> Column:
    return F.split(F.regexp_replace(joined, CUT + r"\s+", CUT), CUT)


def sentences(text, known: Boundaries | None = None) -> Column:
    """Split after . ! ? (and quotes or brackets closed there) and white space, where ``known`` has a sentence end.

    One pass cuts at every such place; of the pieces' last and first words each cut is then kept or not. ``known`` None:
    all are kept."""
    t = col(text)
    if known is None:
        return F.split(F.regexp_replace(t, MAYBE_END, "$1" + CUT), CUT)

    def decided(ps, v):
        def one(p, i):
            after = F.get(ps, i + 1)
            return F.when(after.isNull(), p).when(known.ends(F.get(v, i), after), F.concat(p, F.lit(CUT))).otherwise(p)

        return F.array_join(F.transform(ps, one), "")

    return _cut(_bind(_pieces(t), lambda ps: _bind(known.told(ps), lambda v: decided(ps, v))))


def places(text, kind, *but: str) -> Column:
    """Array of struct(i, kind, a, first): the places i of a text where the last word before ends in a dot and isn't of the
    kinds ``but``, its kind by ``kind`` ('dots' if it has more than one), its type and the first word after."""

    def each(ps, v):
        first = lambda x, i: F.when(~x["kind"].isin("sign", *but), first_word(F.get(ps, i + 1)))
        every = F.transform(v, lambda x, i: F.struct(i.alias("i"), x["kind"].alias("kind"), x["a"].alias("a"), first(x, i).alias("first")))
        return F.filter(every, lambda x: x["first"].isNotNull())

    return _bind(_pieces(col(text)), lambda ps: _bind(_told(ps, kind), lambda v: each(ps, v)))


def sentences_but(text, within) -> Column:
    """:func:`sentences` where those of a text's places that end none are given, as an array or null. Each piece is put
    together once, so the work is in proportion to the text."""
    t, given = col(text), F.coalesce(col(within), F.array().cast("array<int>"))

    def parted(ps, ends):
        both = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform(ends, lambda i: i + 1)).alias("a"), F.concat(ends, F.array(F.size(ps) - 1)).alias("b"))
        return F.array_join(F.transform(both, lambda x: F.array_join(F.slice(ps, x["a"] + 1, x["b"] - x["a"] + 1), "")), CUT)

    ends = lambda ps: F.when(F.size(ps) > 1, F.array_except(F.sequence(F.lit(0), F.size(ps) - 2), given)).otherwise(F.array().cast("array<int>"))
    return F.when(t.isNotNull(), _cut(_bind(_pieces(t), lambda ps: _bind(ends(ps), lambda e: parted(ps, e)))))


def words(text) -> Column:
    return F.filter(F.split(F.trim(col(text)), r"\s+"), lambda w: w != "")


def spaced_words(text) -> Column:
    """Number of words of a text without white space but single spaces: these are counted."""
    t = F.trim(col(text))
    return F.when(t == "", 0).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1)


def measured_sentences(text, known: Boundaries | None = None, squeezed: bool = False) -> Column:
    """Array of struct(s, n): sentences with their numbers of words, each counted once; ``squeezed``: by the spaces."""
    count = spaced_words if squeezed else lambda s: F.size(words(s))
    return F.transform(sentences(text, known), lambda s: F.struct(s.alias("s"), count(s).alias("n")))


def pack_measured(measured, max_words: int = 200, min_tail: int = 30) -> Column:
    """Chunks of whole sentences of at most ``max_words`` words.

    Sentences are added while they fit; a longer sentence is a chunk of its own; a last chunk under ``min_tail`` words
    is glued to the one before. A fold over the sentences, in one expression: no shuffle and no Python. An array that grows
    is copied each time: where each sentence is a chunk, as all of them have a word, none is folded."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))
    state = lambda done, now, n: F.struct(done.alias("done"), now.alias("now"), n.alias("n"))

    def step(acc, x):
        n = acc["n"] + x["n"]
        alone = F.when(n <= max_words, n).otherwise(x["n"])
        more = F.concat(acc["now"], F.lit(" "), x["s"])
        return F.when(acc["now"] == "", state(acc["done"], x["s"], alone)).when(n <= max_words, state(acc["done"], more, n)).otherwise(state(F.array_append(acc["done"], acc["now"]), x["s"], x["n"]))

    def finish(acc):
        done, now = acc["done"], acc["now"]
        glued = F.array_append(F.slice(done, 1, F.size(done) - 1), F.concat_ws(" ", F.try_element_at(done, F.lit(-1)), now))
        return F.when(now == "", done).when((F.size(done) > 0) & (acc["n"] < min_tail), glued).otherwise(F.array_append(done, now))

    m = col(measured)
    folded = F.aggregate(m, empty, step, finish)
    if max_words > 1 or min_tail > 1:
        return folded
    return F.when(F.exists(m, lambda x: x["n"] == 0), folded).otherwise(F.transform(m, lambda x: x["s"]))


def pack_sentences(text, max_words: int = 200, min_tail: int = 30, known: Boundaries | None = None) -> Column:
    return pack_measured(measured_sentences(text, known), max_words, min_tail)


def clean_answer(text) -> Column:
    """Speaker's name at the start and dots of omission removed."""
    t = F.regexp_replace(col(text), r"^(?i)[A-Z ]{1,15}:", "")
    return F.trim(F.regexp_replace(t, r"…|\.{3}", ""))


def is_question(paragraph) -> Column:
    """Starts with Question or Q: (brackets aside), or is one bracket as a whole."""
    p = col(paragraph)
    bare = F.trim(F.translate(p, "[]", ""))
    one = F.length(p) - F.length(F.replace(p, F.lit("["), F.lit(""))) == 1
    return bare.rlike("^(Question|Q:)") | (one & p.startswith("[") & p.endswith("]"))


def qa_paragraph(paragraph) -> Column:
    """struct(is_question, text) of one paragraph."""
    p = col(paragraph)
    return F.struct(is_question(p).alias("is_question"), clean_answer(F.trim(F.translate(p, "[]", ""))).alias("text"))


def qa_paragraphs(qa) -> Column:
    """Array of such structs of a tab-joined cell; null stays null."""
    return F.transform(F.split(col(qa), "\t"), qa_paragraph)


def qa_text(paragraphs) -> Column:
    """Tab-joined paragraphs without headings of transcripts and those of under 5 signs besides spaces."""
    kept = F.filter(col(paragraphs), lambda p: (F.length(F.replace(p, F.lit(" "), F.lit(""))) >= 5) & ~p.rlike(TRANSCRIPT_SKIP))
    return F.array_join(kept, "\t")


def normalise_quotes(text, with_: str) -> Column:
    return F.replace(col(text), F.lit('"'), F.lit(with_))


def inline_marks(html) -> Column:
    """Bold and emphasised text in square brackets."""
    return F.regexp_replace(col(html), r"(?is)<(b|strong|em)(?:\s[^>]*)?>(.*?)</\1>", "[$2]")


def plain_words(text) -> Column:
    """Lower case, letters a-z only, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^a-z\s]", " "), r"\s+", " "))


def clean_date(date) -> Column:
    """d/m/y or ISO text to a date; null if neither."""
    d = col(date)
    return F.coalesce(F.try_to_timestamp(d, F.lit("d/M/yyyy")).cast("date"), F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).cast("date"))


def pretty_feature(name) -> Column:
    """A feature's name for tables: model first letter up, separators as spaces, d_ as a delta, :lagN as (t-N)."""
    n = col(name)
    lag = F.regexp_extract(n, r":lag(\d+)$", 1)
    base = F.regexp_replace(F.regexp_replace(n, r":lag\d+$", ""), "^d_", "")
    text = F.initcap(F.replace(base, F.lit("_"), F.lit(" ")))
    for a, b in (("Is ", "IS "), ("Qa ", "Q&A "), ("Mp ", "MP "), ("Ep ", "EP "), ("Fs ", "FS "), ("Oi ", "OI ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.when(n.startswith("d_"), F.concat(F.lit("Δ "), text)).otherwise(text)
    return F.when(lag != "", F.concat(text, F.lit(" (t-"), lag, F.lit(")"))).otherwise(text)
