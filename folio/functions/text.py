"""Text functions as column expressions: cleaning, scripts, quality, tokens, entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words, patterns and keywords that results depend on.
STOP_WORDS = (
    "a", "an", "and", "document", "documents", "for", "from", "in", "is", "of", "on", "or", "please", "query", "source", "the", "to", "with", "기반",
    "기반으로", "내용", "대한", "문서", "문서를", "분석해줘", "설명", "설명해줘", "요청", "작성", "작성해줘", "정보", "정리", "정리해줘", "질문", "찾아줘", "쿼리", "해줘",
)
TOKEN = "[0-9A-Za-z가-힣]+"
UPPER_CODE = "(?U)\\b[A-Z][A-Z0-9&.\\-/]{1,20}\\b"
NUMERIC_CODE = "(?U)\\b[0-9]{4,8}\\b"
NUMBER_WITH_UNIT = "(?iU)\\b[0-9][0-9,]*(?:\\.[0-9]+)?(?:%|원|달러|만원|억원|천원|십억원|백만원|조원)\\b"
FINANCIAL_KEYWORDS = ("buy", "sell", "hold", "목표주가", "현재주가", "상승여력", "consensus data", "key data", "stock price", "financial data")
TICKER = "\\([0-9]{4,6}\\)"
HANGUL = "가-힣ᄀ-ᇿㄱ-ㆎ㆏㄰"
KANA_HAN = "぀-ヿ一-鿿"
ALLOWED = "[0-9A-Za-z" + HANGUL + KANA_HAN + ".,;:!?\\-_/\\\\%&()\\[\\]{}+*#'\"“”‘’·~`=@|<>$^]"
LONG_TOKEN, RUN_LIMIT, REPEATS = 24, 12.0, 4


def strip(text: Column) -> Column:
    """Trim of Unicode white space; ``F.trim`` removes spaces only."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def clean_text(text: Column) -> Column:
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), "\\r\\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(lines, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def script_counts(text: Column) -> tuple[Column, Column, Column, Column]:
    """Hangul, Latin letters and digits, kana and Han, and all other visible characters."""
    hangul = F.regexp_count(text, F.lit(f"[{HANGUL}]"))
    latin = F.regexp_count(text, F.lit("[A-Za-z0-9]"))
    han = F.regexp_count(text, F.lit(f"[{KANA_HAN}]"))
    return hangul, latin, han, F.regexp_count(text, F.lit("(?U)\\S")) - hangul - latin - han


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("((?U)\\S+)"), F.lit(1))


def weird_ratio(text: Column) -> Column:
    visible = F.regexp_count(text, F.lit("(?U)\\S"))
    return F.when(visible > 0, 1 - F.regexp_count(text, F.lit(ALLOWED)) / visible).otherwise(1.0)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _long_share(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.size(F.filter(found, lambda w: F.length(w) >= LONG_TOKEN)) / F.size(found)).otherwise(1.0)


def long_token_ratio(text: Column) -> Column:
    return let(words(text), _long_share)


def longest_run(text: Column) -> Column:
    """Length of the longest run of one visible character; 1 in any text."""
    runs = F.regexp_extract_all(text, F.lit("(?sU)((\\S)\\2+)"), F.lit(1))
    return F.coalesce(F.greatest(F.lit(1), F.array_max(F.transform(runs, lambda r: F.length(r)))), F.lit(1))


def _repeated(found: Column) -> Column:
    def share(found: Column) -> Column:
        # Equal words are neighbours in a sorted array: a place counts if a window of four around it has equal ends.
        def often(w: Column, i: Column) -> Column:
            ends = [(F.get(found, i - k) == w) & (F.get(found, i - k + REPEATS - 1) == w) for k in range(REPEATS)]
            return F.coalesce(*(F.when(e, True) for e in ends), F.lit(False))

        # Fewer words than that repeat nothing so often.
        return F.when(F.size(found) < REPEATS, 0.0).otherwise(F.size(F.filter(found, often)) / F.greatest(F.lit(1), F.size(F.array_distinct(found))))

    return let(F.sort_array(found), share)


def repeated_share(text: Column) -> Column:
    """Occurrences of words that stand four times or more, by the number of distinct words."""
    return _repeated(words(text))


def repeat_penalty(text: Column) -> Column:
    return F.when(F.length(text) == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(longest_run(text) / RUN_LIMIT, repeated_share(text))))


def measures(cleaned: Column) -> Column:
    """struct<weird, long_tokens, repeat, quality> of text that ``clean_text`` has been over; each count is taken once."""
    hangul, latin, han, _ = script_counts(cleaned)
    counted = F.struct(
        F.length(cleaned).alias("length"), hangul.alias("hangul"), latin.alias("latin"), han.alias("han"), F.regexp_count(cleaned, F.lit("(?U)\\S")).alias("visible"),
        F.regexp_count(cleaned, F.lit(ALLOWED)).alias("allowed"), longest_run(cleaned).alias("run"), words(cleaned).alias("words"),
    )

    def shares(c: Column) -> Column:
        weird = F.when(c["visible"] > 0, 1 - c["allowed"] / c["visible"]).otherwise(1.0)
        repeat = F.when(c["length"] == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(c["run"] / RUN_LIMIT, _repeated(c["words"]))))
        other = c["visible"] - c["hangul"] - c["latin"] - c["han"]
        return F.struct(weird.alias("weird"), _long_share(c["words"]).alias("long_tokens"), repeat.alias("repeat"), c["length"].alias("length"), other.alias("other"), *((c[n] > 0).cast("int").alias(n) for n in ("hangul", "latin", "han")))

    def scored(m: Column) -> Column:
        length, other = m["length"], m["other"]
        groups = m["hangul"] + m["latin"] + m["han"] + (other > 0).cast("int")
        mixed = F.when(groups >= 4, 1.0).when((groups == 3) & (other > 0), 0.7).when(other > 0, F.least(F.lit(1.0), other / length)).otherwise(0.0)
        short = F.when(length < 6, 1.0).when(length < 15, 0.5).otherwise(0.0)
        score = 1.0 - m["weird"] * 0.4 - mixed * 0.3 - F.greatest(m["repeat"], m["long_tokens"]) * 0.2 - short * 0.1
        quality = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score + 1e-9, 4))))
        return F.struct(m["weird"].alias("weird"), m["long_tokens"].alias("long_tokens"), m["repeat"].alias("repeat"), quality.alias("quality"))

    return let(let(counted, shares), scored)


def text_quality(cleaned: Column) -> Column:
    """0 to 1, four places, for text that ``clean_text`` has been over."""
    return measures(cleaned)["quality"]


def language_of(hangul: Column, latin: Column, han: Column) -> Column:
    """Language by the largest script; ties, and no letters at all, go to Korean."""
    return F.when(hangul >= F.greatest(latin, han), "ko").when(latin >= han, "en").otherwise("unknown")


def financial_signal(text: Column) -> Column:
    lower = F.lower(text)
    found = text.rlike(TICKER)
    for word in FINANCIAL_KEYWORDS:
        found = found | lower.contains(word)
    return F.coalesce(found, F.lit(False))


def tokens(text: Column) -> Column:
    """Lower-case search tokens in order, repeats kept."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1)), lambda t: F.lower(t))


def normalize_query(query: Column) -> Column:
    return strip(F.regexp_replace(query, "(?U)\\s+", " "))


def query_tokens(query: Column) -> Column:
    stops = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(tokens(query), lambda t: (F.length(t) >= 2) & ~F.array_contains(stops, t)))


def entity_candidates(query: Column) -> Column:
    found = [F.regexp_extract_all(query, F.lit(f"({p})"), F.lit(1)) for p in (UPPER_CODE, NUMERIC_CODE, NUMBER_WITH_UNIT)]
    return F.array_distinct(F.concat(*found))


def dedupe_texts(values: Column, limit: int | None = None) -> Column:
    """Trimmed, non-empty values in order, the first of each when case is ignored."""
    trimmed = F.filter(F.transform(values, lambda v: strip(v)), lambda v: F.length(v) > 0)

    def firsts(kept: Column) -> Column:
        # Sorted by lower case, then place, the first of each is the one that differs from its neighbour.
        keyed = F.array_sort(F.transform(kept, lambda v, i: F.struct(F.lower(v).alias("key"), i.alias("place"), v.alias("value"))))
        fresh = let(keyed, lambda rows: F.filter(rows, lambda x, i: (i == 0) | (F.get(rows, i - 1)["key"] != x["key"])))
        return F.transform(F.array_sort(F.transform(fresh, lambda x: F.struct(x["place"].alias("place"), x["value"].alias("value")))), lambda x: x["value"])

    first = let(trimmed, firsts)
    return first if limit is None else F.slice(first, 1, limit)


def lexical_query(entities: Column, query_words: Column) -> Column:
    return F.array_join(dedupe_texts(F.concat(entities, query_words)), " ")


def stable_hash(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("::", *parts)), 1, 12)


def safe_name(value: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(value, "[^a-zA-Z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.when(F.length(name) > 0, name).otherwise("call")


def role_name(value: Column) -> Column:
    """A generated role's name as an identifier, or null if nothing is left of it."""
    base = F.regexp_replace(F.regexp_replace(F.lower(strip(value)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    started = F.when(base.rlike("^[a-z]"), base).otherwise(F.concat(F.lit("role_"), base))
    ended = F.when(F.length(started) < 3, F.concat(started, F.lit("_block"))).otherwise(started)
    return F.when(F.length(base) > 0, F.substring(ended, 1, 64))


def duration(ms: Column) -> Column:
    return F.when(ms.isNull(), "").when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit("ms"))).otherwise(F.format_string("%.1fs", ms / 1000))


def color_css(red: Column, green: Column, blue: Column) -> Column:
    return F.format_string("#%02x%02x%02x", red, green, blue)
