"""String functions on lyric-like text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of letters that decides a script, and code-point ranges.
SCRIPTS = (("ja", "\\x{3040}-\\x{30ff}", 0.05), ("ko", "\\x{ac00}-\\x{d7af}", 0.2), ("zh", "\\x{4e00}-\\x{9fff}", 0.2), ("ru", "\\x{0400}-\\x{04ff}", 0.2), ("el", "\\x{0370}-\\x{03ff}", 0.2), ("ar", "\\x{0600}-\\x{06ff}", 0.2), ("he", "\\x{0590}-\\x{05ff}", 0.2), ("th", "\\x{0e00}-\\x{0e7f}", 0.2))
#: Stop words that vote for a language.
STOP_WORDS = {
    "de": ("ich", "und", "nicht", "der", "die", "das", "ist", "du", "mit", "auf", "bin", "mein"),
    "en": ("the", "and", "you", "i'm", "is", "my", "it", "to", "me", "don't", "that"),
    # Two more languages, of our own choice.
    "es": ("que", "los", "del", "las", "por", "con", "una", "para", "el", "y"),
    "fr": ("les", "des", "et", "dans", "du", "est", "pour", "qui", "une", "pas"),
}


def tokens(text: Column) -> Column:
    """Words between white space, each but the last with its trailing space."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.split(plain, "(?<= )"), lambda w: w != "")


def word_key(text: Column) -> Column:
    """Lower case, runs of anything but letters, digits and underscores as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def letter_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")


def anchor_key(text: Column) -> Column:
    """Only words and apostrophes."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_']+"), 0), " ")


def background(text: Column) -> Column:
    """What stands in innermost parentheses, joined by spaces; null if nothing does."""
    found = F.array_join(F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), 1), " ")
    return F.nullif(F.trim(found), F.lit(""))


def without_background(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^()]*\)", " "), r"\s+", " "))


def is_section(text: Column) -> Column:
    """``[Chorus]`` and the like: nothing but a bracketed label."""
    return text.rlike(r"^\s*\[[^\]]*\]\s*$")


#: What stands before the colon of a credit line, without spaces, and what ends a short label of one.
CREDITS = ("lyricsby", "composedby", "arrangedby", "producedby", "writtenby", "lyricist", "composer", "producer", "arranger", "mixedby", "masteredby", "recordedby")
CREDIT_ENDS = ("词", "詞", "曲", "声", "聲", "音")


def is_credit(text: Column) -> Column:
    """A line that names who made the song: a known label, or one of at most four signs that ends like one, before its first colon."""
    label = F.lower(F.regexp_replace(F.regexp_extract(text, r"(?s)^(.*?)[:：]", 1), r"\s+", ""))
    short = (F.length(label) <= 4) & label.rlike("(" + "|".join(CREDIT_ENDS) + ")$")
    return F.coalesce(label.isin(*CREDITS) | short, F.lit(False))


def classify_parentheses(text: Column) -> Column:
    """none, standalone, inline, or skip for unbalanced and nested ones."""
    opened, closed = F.length(F.regexp_replace(text, r"[^(]", "")), F.length(F.regexp_replace(text, r"[^)]", ""))
    return (
        F.when((opened == 0) & (closed == 0), "none")
        .when((opened != closed) | text.rlike(r"\([^)]*\(") | text.rlike(r"^[^(]*\)"), "skip")
        .when(F.trim(text).rlike(r"^\([^()]*\)$"), "standalone")
        .otherwise("inline")
    )


def sync_of(text: Column) -> Column:
    """What a timed-text string carries: word, line or none, by its tags."""
    word = text.rlike(r"<\d+:\d{2}[.:]\d{1,3}>") | text.rlike(r"\S\(\d+,\d+\)")
    line = text.rlike(r"\[\d+:\d{2}(?:[.:]\d{1,3})?\]") | text.rlike(r"\[\d+,\d+\]")
    return F.when(word & line, "word").when(line, "line").otherwise("unsynced")


def capitalised(text: Column) -> Column:
    """The first letter in upper case, wherever it stands."""
    head = F.regexp_extract(text, r"^([^\p{L}]*)", 1)
    at = F.length(head) + 1
    return F.concat(head, F.upper(F.substring(text, at, F.lit(1))), F.substring(text, at + 1, F.length(text)))


def clean_title(title: Column) -> Column:
    """A title without bracketed release notes, tails after a bar and outer quotes."""
    #: Words that mark a bracket or tail as release noise.
    noise = r"official|video|audio|lyrics?|visuali[sz]er|remaster(?:ed)?|live|hd|4k|explicit|clip"
    t = F.regexp_replace(title, rf"(?i)\s*[\(\[][^\)\]]*\b(?:{noise})\b[^\)\]]*[\)\]]", "")
    t = F.regexp_replace(t, rf"(?i)\s+[|–-]\s+[^|–-]*\b(?:{noise})\b.*$", "")
    return F.trim(F.regexp_replace(F.trim(t), r'^["“”](.*)["“”]$', "$1"))


def artist_and_title(title: Column) -> Column:
    """``Artist - Title`` as a struct; without a dash the artist is null."""
    parts = F.split(title, r"\s+[-–—]\s+", 2)
    return F.when(F.size(parts) == 2, F.struct(F.trim(parts[0]).alias("artist"), F.trim(parts[1]).alias("title"))).otherwise(F.struct(F.lit(None).cast("string").alias("artist"), F.trim(title).alias("title")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "-"), r"^-+|-+$", "")


def url_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def video_id(url: Column) -> Column:
    """The id of a video link on a known host, from its path or its ``v`` parameter."""
    #: Hosts that are accepted.
    host = F.regexp_replace(url_host(url), r"^(www|m|music)\.", "")
    path, query = F.regexp_extract(url, r"^[^:]+://[^/?#]+/([\w-]{11})(?:[/?#]|$)", 1), F.regexp_extract(url, r"[?&]v=([\w-]{11})(?:[&#]|$)", 1)
    deep = F.regexp_extract(url, r"/(?:shorts|embed|live)/([\w-]{11})(?:[/?#]|$)", 1)
    found = F.when(host == "youtu.be", path).when(host == "youtube.com", F.coalesce(F.nullif(query, F.lit("")), deep))
    return F.nullif(found, F.lit(""))


def escape_xml(text: Column, quotes: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if quotes else out


def language_tag(tag: Column) -> Column:
    """Two or three letters, an optional script and region in canonical case; null if it is none."""
    form = r"^([a-zA-Z]{2,3})(?:[-_]([a-zA-Z]{4}))?(?:[-_]([a-zA-Z]{2}|\d{3}))?$"
    part = lambda i: F.regexp_extract(tag, form, i)
    script, region = F.initcap(part(2)), F.upper(part(3))
    return F.when(tag.rlike(form), F.concat(F.lower(part(1)), F.when(script != "", F.concat(F.lit("-"), script)).otherwise(""), F.when(region != "", F.concat(F.lit("-"), region)).otherwise("")))


def script_share(text: Column, ranges: str) -> Column:
    """Share of a text's letters that lie in a code-point range."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    own = F.length(F.regexp_replace(text, f"[^{ranges}]", ""))
    return F.when(letters > 0, own / letters).otherwise(F.lit(0.0))


def language_by_script(text: Column) -> Column:
    """The language of the first script whose share is large enough, else null.

    Texts without a letter of any of the scripts are told by one scan.
    """
    out = None
    for lang, ranges, share in SCRIPTS:
        hit = script_share(text, ranges) >= share
        out = F.when(hit, lang) if out is None else out.when(hit, lang)
    return F.when(text.rlike("[" + "".join(ranges for _, ranges, _ in SCRIPTS) + "]"), out)


def stop_words_in(text: Column) -> Column:
    """The whole tokens between white space that are stop words of any language, in lower case."""
    every = sorted({w for own in STOP_WORDS.values() for w in own})
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w.isin(*every))


def stop_word_votes(found: Column) -> dict[str, Column]:
    """How many of the found stop words are of each language."""
    among = lambda own: lambda w: w.isin(*own)
    return {lang: F.size(F.filter(found, among(own))) for lang, own in STOP_WORDS.items()}


def guess_language(docs: DataFrame, text: str = "text", out: str = "guess", fallback: str = "en") -> DataFrame:
    """By script, else the single language with most stop words; a tie or no vote gives ``fallback``.

    A text is cut into tokens once; the few that are stop words are counted in a
    step of its own.
    """
    found = docs.withColumns({"_found": stop_words_in(F.col(text)), "_script": language_by_script(F.col(text))})
    votes = stop_word_votes(F.col("_found"))
    counted = found.withColumns({f"_{k}": v for k, v in votes.items()}).drop("_found")
    own = {k: F.col(f"_{k}") for k in votes}
    top = F.greatest(*own.values())
    leaders = sum((F.when(v == top, 1).otherwise(0) for v in own.values()), F.lit(0))
    named = None
    for lang, v in own.items():
        named = F.when(v == top, lang) if named is None else named.when(v == top, lang)
    guess = F.coalesce("_script", F.when((top > 0) & (leaders == 1), named), F.lit(fallback))
    return counted.withColumn(out, guess).drop("_script", *[f"_{k}" for k in votes])


def han_pieces(text: Column) -> Column:
    """Each Han character a piece, other runs whole, punctuation joined to the piece before it."""
    return F.regexp_extract_all(text, F.lit(r"(?:\p{IsHan}|[^\s\p{IsHan}\p{P}]+)\p{P}*|\p{P}+"), 0)


def terms_match(text: Column, terms: Column) -> Column:
    """Whether every term, lower-cased, is contained in the text."""
    return F.forall(F.filter(F.split(F.lower(F.trim(terms)), r"\s+"), lambda t: t != ""), lambda t: F.contains(F.lower(text), t))


def names_title(line: Column, title: Column) -> Column:
    """Whether a line only names the song: it begins with the title and holds " - "."""
    return F.startswith(F.lower(line), F.lower(title)) & F.contains(line, F.lit(" - "))


def token_clean(text: Column) -> Column:
    """Letters, digits and apostrophes only."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}']", "")


def clean_marks(text: Column, mark: str = "|", strip: bool = False) -> Column:
    """Split marks without repeats and not at the edge of a word; without any if ``strip``."""
    if strip:
        return F.replace(text, F.lit(mark), F.lit(""))
    one = F.regexp_replace(text, rf"[{mark}]+", mark)
    return F.regexp_replace(one, rf"(^|\s)[{mark}]|[{mark}]($|\s)", "$1$2")


def split_marked(text: Column, mark: str = "|") -> Column:
    """Pieces of a text cut at white space and split marks, as ``(text, spaced)``: whether a space follows."""
    words = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    cut = lambda t: F.filter(F.split(t, rf"[{mark}]"), lambda x: x != "")
    last = F.size(words) - 1
    return F.flatten(F.transform(words, lambda t, i: F.transform(cut(t), lambda x, j: F.struct(x.alias("text"), ((j == F.size(cut(t)) - 1) & (i < last)).alias("spaced")))))


def transliteration_text(text: Column) -> Column:
    """A reading with one space inside its words and two between them."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s{2,}", "\x01"), r"\s", " "), "\x01", "  "))


def transliteration_groups(text: Column) -> Column:
    return F.filter(F.split(transliteration_text(text), " {2}"), lambda g: g != "")


def separator_runs(text: Column) -> Column:
    """Runs of white space and dashes as ``(kind, size)``."""
    runs = F.regexp_extract_all(text, F.lit(r"[\s\-‐-―]+"), 0)
    return F.transform(runs, lambda r: F.struct(F.when(r.rlike(r"[\-‐-―]"), "dash").otherwise("space").alias("kind"), F.length(r).alias("size")))


def source_fingerprint(text: Column, background: Column, mark: str = "|") -> Column:
    """Equal for equal texts on both tracks, split marks aside; only equality means anything."""
    bare = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(mark), F.lit(""))
    return F.md5(F.concat(bare(text), F.lit("\x00"), bare(background)))
