"""Quality rules: a table of thresholds compiled into one Spark projection.

The projection computes a struct of counts and ratios for each text and the names of the rules it
breaks; no user function runs. A text's words are bound once, in a lambda, so each is extracted once.

Edge cases: a null text counts as an empty one, with no words, and fails on length; an empty table
gives an empty result; repeated rows are judged alike; other columns are kept, whatever their names.
Repeated windows are those of equal 64-bit hashes, which are not compared word by word: two different
windows of a text of n words would be taken as equal with a probability of about n^2 / 2^65. The rule
of stop words knows four languages only and rejects long texts of any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of the four languages served.
STOP_WORDS = (
    "the of and to in a is that it was for on are with as be at this have from or by not he we you they his her"
    " le la les de des du un une et est en que qui dans pour pas sur au aux avec ce par il elle"
    " der die das und ist in den von zu mit sich auf ein eine nicht für als auch es an dem im"
    " el los las y en un una por con para se del su al lo como no más"
).split()


@dataclass(frozen=True)
class Rule:
    """`measure` (a measure's SQL) must be at least `least` and at most `most`, where given."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Judged on every text, besides the base rules. Measures are of the struct m, see MEASURES.
RULES = (
    Rule("mean_word_length", "m.word_chars / m.n_words", 1.5, 25),
    Rule("symbols_per_word", "m.n_symbols / m.n_words", most=0.25),
    Rule("repeated_lines", "m.n_dup_lines / greatest(m.n_lines, 1)", most=0.5),
    Rule("stop_words_per_word", "if(m.n_words < 50, 1, m.n_stop_words / m.n_words)", least=0.01),
    Rule("capitals_per_letter_like", "m.n_capitals / greatest(m.word_chars, 1)", most=0.5),
    Rule("bangs_per_word", "m.n_bangs / m.n_words", most=0.5),
)
#: The base rules: enough words, and at most so many per cent of them in repeated windows.
LEAST_WORDS, MOST_REPEAT_PERCENT = 10, 20


def _quote(s: str) -> str:
    return "'" + "".join({"\\": "\\\\", "'": "\\'"}.get(c, c if " " < c <= "~" or ord(c) > 127 else f"\\u{ord(c):04x}") for c in s) + "'"


def _repeat_words() -> str:
    """Words inside 5-word windows that occur twice or more. Equal windows are neighbours once the
    windows' hashes are sorted; their places, sorted, are summed as a union of intervals. Texts
    without an equal pair (most) stop after the distinct count."""
    grams = f"transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(WINDOW))}))"
    paired = "array_sort(transform(g, (x, i) -> named_struct('x', x, 'i', i)))"
    twice = "filter(s, (e, i) -> (i > 0 and s[i - 1].x = e.x) or (i < size(s) - 1 and s[i + 1].x = e.x))"
    union = f"aggregate(sort_array(transform({twice}, e -> e.i)), named_struct('n', 0L, 'e', 0), (a, p) -> named_struct('n', a.n + p + {WINDOW} - greatest(p, a.e), 'e', p + {WINDOW}), a -> a.n)"
    return (
        f"if(size(w) < {WINDOW}, 0L, transform(array({grams}), g -> if(size(array_distinct(g)) = size(g), 0L, "
        f"transform(array({paired}), s -> {union})[0]))[0])"
    )


def measures(text_col: str) -> Column:
    """The struct m of a text column: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words,
    n_capitals, n_bangs, n_repeat_words (all long)."""
    stop = ", ".join(_quote(w) for w in sorted(set(STOP_WORDS)))
    lines = "filter(split(t, '\\n', -1), x -> length(trim(BOTH {s} FROM x)) > 0)".replace("{s}", _quote(SPACE))
    inner = (
        "named_struct('n_words', cast(size(w) as bigint), "
        f"'word_chars', cast(length(translate(t, {_quote(SPACE)}, '')) as bigint), "
        f"'n_symbols', cast(length(t) - length(translate(t, {_quote(SYMBOLS)}, '')) as bigint), "
        "'n_lines', cast(size(l) as bigint), 'n_dup_lines', cast(size(l) - size(array_distinct(l)) as bigint), "
        f"'n_stop_words', cast(size(filter(w, x -> lower(x) in ({stop}))) as bigint), "
        "'n_capitals', cast(length(t) - length(regexp_replace(t, '\\\\p{Lu}', '')) as bigint), "
        "'n_bangs', cast(length(t) - length(translate(t, '!', '')) as bigint), "
        f"'n_repeat_words', {_repeat_words()})"
    )
    bound = (
        "transform(array(coalesce(__text, '')), t -> transform(array(named_struct("
        f"'w', regexp_extract_all(t, {_quote(WORD)}, 0), 'l', {lines})), z -> "
        f"transform(array(z.w), w -> transform(array(z.l), l -> {inner})[0])[0])[0])[0]"
    )
    return F.expr(bound.replace("__text", f"`{text_col}`"))


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "quality") -> DataFrame:
    """`docs` with a struct `out`: m (the measures), base_failed, broken (names of the method's
    rules it breaks; none are judged for a text without words) and kept."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"a column {out} is in the way; choose another name")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    verdicts = []
    for r in rules:
        bad = [f"{r.measure} < {r.least}"] * (r.least is not None) + [f"{r.measure} > {r.most}"] * (r.most is not None)
        verdicts.append(f"if(m.n_words > 0 and ({' or '.join(bad)}), '{r.name}', null)")
    base = f"m.n_words < {LEAST_WORDS} or 100 * m.n_repeat_words > {MOST_REPEAT_PERCENT} * m.n_words"
    verdict = (
        f"transform(array(m0), m -> transform(array(named_struct('b', {base}, 'r', array_compact(array({', '.join(verdicts)})))), "
        "v -> named_struct('m', m, 'base_failed', v.b, 'broken', v.r, 'kept', not v.b and size(v.r) = 0))[0])[0]"
    )
    measured = packed.select("doc", measures("text").alias("m0"))
    return measured.select("doc.*", F.expr(verdict).alias(out))


def keep(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs` that no rule rejects; same columns."""
    name = "__quality"
    judged = judge(docs, text_col, rules, name)
    return judged.filter(F.col(f"{name}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
