"""Text expressions: normalization, words, search terms, sentence breaks, heading paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop list of the keyword channel.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did "
    "do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into "
    "is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she "
    "should so some such than that the their theirs them themselves then there these they this those through to too under until up very "
    "was we were what when where which while who whom why will with would you your yours yourself yourselves"
).split()

# Fixed value: passages that read like an instruction to a language model.
INSTRUCTION_LIKE = (
    r"ignore (all |any )?(the )?(previous|prior|above) instructions|disregard (all |any )?(the )?(previous|prior|above)"
    r"|system (note|prompt|message)|note to (the )?(ai|assistant)|if you are an? (ai|language model|assistant)"
    r"|as an ai (assistant|model)|you must (now )?(reply|respond|answer) with"
)

# Limits of chunks and embedded heading paths.
MAX_CHUNK_CHARS = 2000
MAX_CHUNK_WORDS = 180
OVERLAP_WORDS = 30
MAX_INPUT_TOKENS = 384
SPECIAL_TOKENS = 2
PATH_SEPARATOR = " > "
PATH_MAX_CHARS = 200

# A Unicode noncharacter, which text may not contain, marks a break before it is split on.
MARK = "\ufdd0"


def normalize(text: Column) -> Column:
    """One line-feed convention, no byte-order mark, no outer whitespace, exactly one final line feed."""
    unified = F.regexp_replace(text, "\r\n|\r", "\n")
    return F.concat(strip(F.regexp_replace(unified, "\\A\ufeff", "")), F.lit("\n"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+\z", "")


def strip_start(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+", "")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), 1))


def plain_words(text: Column) -> Column:
    """Lower-case ASCII words and numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def stem(word: Column) -> Column:
    """The S-stemmer: strips English plural endings."""
    size = F.length(word)
    return (
        F.when(word.rlike("(?<![ea])ies$"), F.concat(F.substring(word, 1, size - 3), F.lit("y")))
        .when(word.rlike("(?<![aeo])es$"), F.substring(word, 1, size - 1))
        .when(word.rlike("(?<![us])s$"), F.substring(word, 1, size - 1))
        .otherwise(word)
    )


def terms(text: Column) -> Column:
    """Search terms in text order: words without stop words, stemmed. Repeats stay."""
    return F.transform(F.filter(plain_words(text), lambda w: ~w.isin(*STOPWORDS)), stem)  # a hash set


def mark_sentences(text: Column) -> Column:
    """Puts MARK after the whitespace that ends a sentence and before a list item on a new line."""
    ended = F.regexp_replace(text, r"""([.!?]["')\]]{0,2}\s+)""", f"$1{MARK}")
    return F.regexp_replace(ended, r"(\n)([ \t]*(?:[-*+]|\d+[.)])[ \t])", f"$1{MARK}$2")


def sentence_parts(text: Column) -> Column:
    """The sentences in order, each with the whitespace that follows it, so the lengths add up to the text."""
    return F.filter(F.split(mark_sentences(text), MARK), lambda s: s != "")


def embedded_path(section_path: Column) -> Column:
    """The innermost headings of a path whose joined length fits the limit; a single longer heading is cut."""
    parts = F.split(section_path, PATH_SEPARATOR)
    kept = F.aggregate(
        F.reverse(parts),
        F.struct(F.lit(None).cast("string").alias("path"), F.lit(True).alias("open")),
        lambda acc, part: F.when(acc["path"].isNull(), F.struct(part.alias("path"), F.lit(True).alias("open"))).otherwise(
            F.when(
                acc["open"] & (F.length(acc["path"]) + F.length(part) + len(PATH_SEPARATOR) <= PATH_MAX_CHARS),
                F.struct(F.concat(part, F.lit(PATH_SEPARATOR), acc["path"]).alias("path"), F.lit(True).alias("open")),
            ).otherwise(F.struct(acc["path"].alias("path"), F.lit(False).alias("open")))
        ),
        lambda acc: acc["path"],
    )
    return F.coalesce(F.substring(kept, 1, PATH_MAX_CHARS), F.lit(""))


def with_context(section_path: Column, content: Column) -> Column:
    """What is embedded for a chunk: its heading path, a blank line, the chunk."""
    path = embedded_path(section_path)
    return F.when(path == "", content).otherwise(F.concat(path, F.lit("\n\n"), content))


def normalize_answer(text: Column) -> Column:
    """Lower case, no thousands separators, single spaces."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?<=\d),(?=\d)", ""), r"\s+", " "))


def instruction_like(text: Column) -> Column:
    return text.rlike("(?i)" + INSTRUCTION_LIKE)


def quoted(text: Column) -> Column:
    """Evidence markers inside quoted text are escaped, whatever their case."""
    return F.regexp_replace(text, "(?i)<(/?)(evidence)", "&lt;$1$2")
