"""Edits of lines as table transforms: backgrounds, groups and instances, moves, imports and migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shapes import LINE, TRACK

#: Fixed value: length of a background word that has no time of its own, in milliseconds.
BACKGROUND_WORD = 300


def bracketed(words: DataFrame, by: tuple[str, ...] = TRACK) -> DataFrame:
    """An opening bracket before a group's first word and a closing one behind its last, inside its trailing space."""
    w = Window.partitionBy(*by)
    last = F.max("word_no").over(w)
    closed = F.concat(F.rtrim("text"), F.lit(")"), F.when(F.endswith("text", F.lit(" ")), " ").otherwise(""))
    text = F.when(F.col("word_no") == last, closed).otherwise(F.col("text"))
    return words.withColumn("text", F.concat(F.when(F.col("word_no") == F.min("word_no").over(w), "(").otherwise(""), text))


def background_words(lines: DataFrame) -> DataFrame:
    """Words of ``background`` with times: from ``at_ms`` on, 300 ms each, cut at the line's end; without ``at_ms`` in equal shares of the second half of the line."""
    words = F.filter(F.split("background", r"\s+"), lambda t: t != "")
    each = lines.withColumn("_n", F.size(words)).select(*lines.columns, "_n", F.posexplode(words).alias("word_no", "text"))
    half = (F.col("begin_ms") + F.col("end_ms")) / 2
    share = (F.col("end_ms") - half) / F.col("_n")
    at = lambda k: F.when(F.col("at_ms").isNull(), half + share * k).otherwise(F.least(F.col("end_ms"), F.col("at_ms") + k * BACKGROUND_WORD).cast("double"))
    return each.withColumns({"word_begin": at(F.col("word_no")), "word_end": at(F.col("word_no") + 1)}).drop("_n")


def filled(rows: DataFrame, lines: DataFrame, by: str = "paste") -> DataFrame:
    """Pastes of text rows (paste, song, line_no, text) into existing lines: all of a paste's rows, or ``ok`` is false if a line is missing, grouped or has words."""
    met = rows.join(lines.select(*LINE, "group_id", "n_words"), list(LINE), "left")
    free = F.col("n_words").isNotNull() & F.col("group_id").isNull() & (F.col("n_words") == 0)
    return met.withColumn("ok", F.every(free).over(Window.partitionBy(by))).drop("group_id", "n_words")


def merged_agents(existing: DataFrame, declared: DataFrame, used: DataFrame) -> DataFrame:
    """Voices after an import (song, id, name, kind): declared ones update or are added, others survive only where a line uses them."""
    e = existing.select("song", "id", F.col("name").alias("_n"), F.col("kind").alias("_k"), F.lit(True).alias("_e"))
    d = declared.select("song", "id", F.col("name").alias("_dn"), F.col("kind").alias("_dk"), F.lit(True).alias("_d"))
    u = used.select("song", F.col("agent").alias("id"), F.lit(True).alias("_u")).distinct()
    met = e.join(d, ["song", "id"], "full_outer").join(u, ["song", "id"], "left")
    kept = met.where(F.col("_d") | F.col("_u"))
    state = F.when(F.col("_e").isNull(), "added").when(F.col("_d"), "updated").otherwise("kept")
    return kept.select("song", "id", F.coalesce("_dn", "_n").alias("name"), F.coalesce("_dk", "_k").alias("kind"), state.alias("state"))


def known_agents(lines: DataFrame, agents: DataFrame) -> DataFrame:
    """Lines whose voice no table names get the song's first voice."""
    first = agents.groupBy("song").agg(F.min("id").alias("_first"))
    met = lines.join(agents.select("song", F.col("id").alias("agent"), F.lit(True).alias("_known")), ["song", "agent"], "left").join(first, "song", "left")
    return met.withColumn("agent", F.when(F.col("_known"), F.col("agent")).otherwise(F.coalesce("_first", "agent"))).drop("_known", "_first")


def detached(lines: DataFrame, instances: DataFrame) -> DataFrame:
    """Lines of the named instances (song, group_id, instance) without their links; other songs may have groups of that name."""
    key = ["song", "group_id", "instance"]
    met = lines.join(instances.select(*key, F.lit(True).alias("_x")).distinct(), key, "left")
    off = F.coalesce("_x", F.lit(False))
    return met.withColumns({"linked": ~off & F.col("group_id").isNotNull(), "group_id": F.when(~off, F.col("group_id")), "instance": F.when(~off, F.col("instance"))}).drop("_x")


def without_last_space(words: DataFrame) -> DataFrame:
    last = F.max("word_no").over(Window.partitionBy(*TRACK))
    return words.withColumn("text", F.when(F.col("word_no") == last, F.rtrim("text")).otherwise(F.col("text")))


def slot_counts(lines: DataFrame, mark: str = "|") -> DataFrame:
    """Slots of a line's text (words cut at split marks) and how many of them have a timed word."""
    slots = F.size(F.filter(F.split("text", rf"[\s{mark}]+"), lambda t: t != ""))
    return lines.withColumns({"slots": slots, "timed_slots": F.least(slots, F.col("n_words"))})


def explicit_fingerprints(words: DataFrame) -> DataFrame:
    """A key for each word that stays the same over edits elsewhere: in a linked line by template line, else by the line's own number."""
    folded = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", "")
    linked = F.concat_ws(":", F.lit("g"), "group_id", "template_line", "track", "word_no", folded)
    own = F.concat_ws(":", F.lit("l"), "line_no", "track", "word_no", folded)
    return words.withColumn("fingerprint", F.when(F.col("group_id").isNotNull(), linked).otherwise(own))


def edited_text(lines: DataFrame, rewritten: DataFrame) -> DataFrame:
    """The song's text as one string, rewritten rows in place of the stored ones."""
    met = lines.join(rewritten.select(*LINE, F.col("text").alias("_new")), list(LINE), "left")
    rows = F.sort_array(F.collect_list(F.struct("line_no", F.coalesce("_new", "text").alias("t"))))
    return met.groupBy("song").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("text"))


def matched_rows(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of an edited text next to the stored lines: the k-th row that is not empty belongs to the k-th line that is not."""
    def numbered(df: DataFrame, order: str) -> DataFrame:
        return df.where("trim(text) <> ''").withColumn("_k", F.row_number().over(Window.partitionBy("song").orderBy(order)))

    s = numbered(stored, "line_no").select("song", "_k", "line_no", F.col("text").alias("old"))
    out = numbered(parsed, "row_no").join(s, ["song", "_k"], "left").drop("_k")
    return out.withColumn("change", F.when(F.col("line_no").isNull(), "new").when(F.col("old") == F.col("text"), "same").otherwise("changed"))


def paste_decision(target: Column, empty_slots: Column, needed: Column) -> Column:
    """What a pasted instance does: nothing without a target line, fills enough free lines, else asks before lines are added."""
    return F.when(target.isNull(), "no-target").when(empty_slots >= needed, "fill").otherwise("confirm-insert")


def edit_decision(changed: Column, structural: Column, linked: Column) -> Column:
    """What becomes of an edited text: a structural change of linked lines is asked about first."""
    return F.when(~changed, "noop").when(structural & linked, "needs-confirm").when(linked, "apply-to-linked").otherwise("apply")


def line_extremes(selected: DataFrame, lines: DataFrame) -> DataFrame:
    """Begin, end and count of each song's selection; words without times fall back to their line's."""
    met = selected.join(lines.select(*LINE, F.col("begin_ms").alias("_b"), F.col("end_ms").alias("_e")), list(LINE), "left")
    return met.groupBy("song").agg(F.min(F.coalesce("begin_ms", "_b")).alias("begin_ms"), F.max(F.coalesce("end_ms", "_e")).alias("end_ms"), F.count("*").alias("n"))


def effective_bounds(words: DataFrame) -> DataFrame:
    """Bounds of a line's background, and of both tracks; no main word, no common bounds."""
    side = lambda t, f, c: f(F.when(F.col("track") == t, F.col(c)))
    b = words.groupBy(*LINE).agg(side("main", F.min, "begin_ms").alias("mb"), side("main", F.max, "end_ms").alias("me"), side("bg", F.min, "begin_ms").alias("bg_begin"), side("bg", F.max, "end_ms").alias("bg_end"))
    has = F.col("mb").isNotNull()
    return b.select(*LINE, "bg_begin", "bg_end", F.when(has, F.least("mb", "bg_begin")).alias("begin_ms"), F.when(has, F.greatest("me", "bg_end")).alias("end_ms"))


def word_position(keys: Column, key: Column) -> Column:
    """Place of the first word of a line with this key, else 0."""
    return F.greatest(F.array_position(keys, key) - 1, F.lit(0))


def evenly_spread(words: DataFrame, begin: Column, end: Column) -> DataFrame:
    """Words of a line at equal steps between two times; without room all have no length."""
    line = Window.partitionBy(*TRACK)
    step = F.greatest(F.lit(0.0), (end - begin) / F.count("*").over(line))
    nth = F.row_number().over(line.orderBy("word_no")) - 1
    return words.withColumns({"begin_ms": begin + step * nth, "end_ms": begin + step * (nth + 1)})


def syllable_ids(words: DataFrame) -> DataFrame:
    """Ids for runs of syllables, one for each run of a line, unless the line has ids already; whole words have none."""
    w = Window.partitionBy(*TRACK).orderBy("word_no")
    begins = F.coalesce(F.lag(F.endswith("text", F.lit(" "))).over(w), F.lit(True))
    run = words.withColumn("_start", F.last(F.when(begins, F.col("word_no")), ignorenulls=True).over(w))
    size = F.count("*").over(Window.partitionBy(*TRACK, "_start"))
    present = F.max(F.col("syllable_id").isNotNull()).over(Window.partitionBy(*TRACK))
    made = F.when(size > 1, F.concat_ws("-", "song", "line_no", "track", "_start"))
    return run.withColumn("_made", F.when(present, F.col("syllable_id")).otherwise(made)).drop("_start").withColumn("syllable_id", F.col("_made")).drop("_made")


def fresh_ids(words: DataFrame, salt: str) -> DataFrame:
    """Pasted words with new syllable ids, one new id for each old one of a line, so that runs stay together."""
    made = F.when(F.col("syllable_id").isNotNull(), F.substring(F.md5(F.concat_ws("|", F.lit(salt), "song", "line_no", "syllable_id")), 1, 12))
    return words.withColumn("syllable_id", made)


def planned_moves(moves: DataFrame, words: DataFrame, lines: DataFrame) -> DataFrame:
    """Moves (song, line_no, track, word_no, to_line) with the reason why one is refused, else null.

    A move is refused if the word or the target line is missing, if both
    lines belong to different instances, if the target has times of its own
    but no words, or if the word would overlap a word that stays there.
    """
    known = words.select(*TRACK, "word_no", "begin_ms", "end_ms")
    met = moves.join(known, [*TRACK, "word_no"], "left")
    info = lines.select("song", "line_no", "instance", "line_synced")
    met = met.join(info.withColumnRenamed("instance", "_from").drop("line_synced"), ["song", "line_no"], "left")
    target = info.select("song", F.col("line_no").alias("to_line"), F.col("instance").alias("_to"), "line_synced", F.lit(True).alias("_there"))
    met = met.join(target, ["song", "to_line"], "left")
    staying = known.join(moves, [*TRACK, "word_no"], "left_anti").select("song", F.col("line_no").alias("to_line"), "track", F.col("begin_ms").alias("_b"), F.col("end_ms").alias("_e"))
    hit = met.select("song", "line_no", "track", "word_no", "to_line", "begin_ms", "end_ms").join(staying, ["song", "to_line", "track"]).where("_b < end_ms and _e > begin_ms")
    hit = hit.select("song", "line_no", "track", "word_no", "to_line", F.lit(True).alias("_hit")).distinct()
    met = met.join(hit, ["song", "line_no", "track", "word_no", "to_line"], "left")
    reason = F.when(F.col("begin_ms").isNull(), "missing word").when(F.col("_there").isNull(), "missing line").when(~F.col("_from").eqNullSafe(F.col("_to")), "other instance").when(F.col("line_synced"), "line-synced target").when(F.col("_hit"), "overlap")
    return met.select("song", "line_no", "track", "word_no", "to_line", reason.alias("refused"))


def move_plan(planned: DataFrame) -> DataFrame:
    """Removals and inserts of each line and track from the moves that are not refused."""
    ok = planned.where("refused is null")
    gone = ok.select("song", "line_no", "track", F.col("word_no").alias("out"), F.lit(None).cast("int").alias("into"))
    come = ok.select("song", F.col("to_line").alias("line_no"), "track", F.lit(None).cast("int").alias("out"), F.col("word_no").alias("into"))
    return gone.unionByName(come).groupBy(*TRACK).agg(F.sort_array(F.collect_set("out")).alias("removals"), F.count("into").alias("inserts"))


def applied_spans(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Words with times from the aligner: the index of a span runs through a line's main words, then its background."""
    order = Window.partitionBy(*LINE).orderBy(F.desc("track"), "word_no")
    return lines.withColumn("_i", F.row_number().over(order) - 1).join(spans.withColumnRenamed("index", "_i"), [*LINE, "_i"], "left").drop("_i")


def mapped_reading(parts: Column) -> Column:
    """The readings of a word's pieces with their joiners; null if a piece has none."""
    whole = F.forall(parts, lambda p: p["text"].isNotNull())
    return F.when(whole, F.aggregate(parts, F.lit(""), lambda s, p: F.concat(s, p["text"], F.coalesce(p["joiner"], F.lit("")))))


def timed_prefix(reading: Column, timed_groups: Column) -> Column:
    """The first groups of a reading, as many as have times; groups are two spaces apart."""
    return F.array_join(F.slice(F.filter(F.split(reading, " {2}"), lambda g: g != ""), F.lit(1), timed_groups), "  ")


def normalised_metadata(meta: DataFrame) -> DataFrame:
    """One artist of old projects as a list, blanks as missing."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    artists = F.filter(F.coalesce("artists", F.array("artist")), lambda a: a.isNotNull() & (F.trim(a) != ""))
    return meta.withColumns({"artists": F.when(F.size(artists) > 0, artists), "album": blank("album"), "language": F.lower(blank("language"))}).drop("artist")


def unprimed(words: DataFrame, delay: Column, done: Column) -> DataFrame:
    """Times moved back by the encoder's delay, once: projects that are marked as done stay."""
    move = lambda c: F.when(done | F.col(c).isNull(), F.col(c)).otherwise(F.greatest(F.lit(0), F.col(c) - delay))
    return words.withColumns({"begin_ms": move("begin_ms"), "end_ms": move("end_ms")})


def malformed_fields(checks: dict[str, Column]) -> Column:
    """Names of the fields whose check fails; a null check fails too."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))


def stem_name(file: Column) -> Column:
    """The last name in brackets of a stem's file name, lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(file, r"^.*[\(\[]([^\)\]]+)[\)\]][^\(\[]*$", 1)), F.lit(""))


def safe_key(key: Column) -> Column:
    """Whether a key may name a file: no separators, no dots alone, not empty."""
    return F.coalesce((key != "") & ~key.rlike(r"[/\\\x00]") & ~key.rlike(r"^\.+$"), F.lit(False))


def character_tokens(word: Column, alphabet: str) -> Column:
    """Ids of a word's letters in an alphabet, from one; other letters are left out."""
    letters = F.filter(F.split(F.lower(word), ""), lambda c: F.instr(F.lit(alphabet), c).between(1, len(alphabet)) & (c != ""))
    return F.transform(letters, lambda c: F.instr(F.lit(alphabet), c))


def patched(words: DataFrame, patches: DataFrame) -> DataFrame:
    """Words with the fields of a patch at their place; a null field of a patch leaves the word's."""
    p = patches.select(*TRACK, "word_no", *[F.col(c).alias(f"_{c}") for c in ("text", "begin_ms", "end_ms")])
    met = words.join(p, [*TRACK, "word_no"], "left")
    return met.withColumns({c: F.coalesce(f"_{c}", c) for c in ("text", "begin_ms", "end_ms")}).drop("_text", "_begin_ms", "_end_ms")


def identical_split(words: DataFrame, source: Column, at: int) -> DataFrame:
    """The word ``source`` picks and all words of its song with the same text cut after ``at`` letters; words are numbered anew."""
    chosen = words.where(source).select("song", F.trim("text").alias("_t")).distinct().withColumn("_x", F.lit(True))
    met = words.withColumn("_t", F.trim("text")).join(chosen, ["song", "_t"], "left")
    cut = F.coalesce("_x", F.lit(False)) & (F.length("_t") > at)
    middle = F.col("begin_ms") + F.floor((F.col("end_ms") - F.col("begin_ms")) * at / F.length("_t"))
    piece = lambda t, b, e: F.struct(t.alias("text"), b.cast("bigint").alias("begin_ms"), e.cast("bigint").alias("end_ms"))
    both = F.array(piece(F.substring("text", 1, at), F.col("begin_ms"), middle), piece(F.substring("text", F.lit(at + 1), F.length("text")), middle, F.col("end_ms")))
    whole = F.array(piece(F.col("text"), F.col("begin_ms"), F.col("end_ms")))
    each = met.select(*TRACK, "word_no", F.posexplode(F.when(cut, both).otherwise(whole)).alias("_k", "_p"))
    nth = F.row_number().over(Window.partitionBy(*TRACK).orderBy("word_no", "_k")) - 1
    return each.select(*TRACK, nth.cast("int").alias("word_no"), "_p.*")
