"""The text signals as DuckDB SQL: relational twins of the column expressions, for checking them."""

from __future__ import annotations

from ..functions import lexicon


def _quoted(items) -> str:
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in items)


WORD = r"[\p{L}\p{N}]+(?:[-''][\p{L}\p{N}]+)*"
OUTER = r"^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$"


def words_of(text: str) -> str:
    found = f"regexp_extract_all(translate({text}, '’‘“”—–', '''''\"\"--'), '{WORD}')"
    return f"list_filter({found}, lambda w: NOT regexp_full_match(w, '\\p{{Nd}}+') AND (strlen(w) > 1 OR lower(w) IN ('i', 'a')))"


def base(source: str) -> str:
    """Common table expressions over a subquery with columns k (key) and t (text)."""
    common = _quoted(lexicon.COMMON_WORDS)
    phrases = ", ".join(f"({i}, {_quoted([pattern])}, {weight}::DOUBLE)" for i, _, pattern, weight in lexicon.PHRASES)
    contractions = " + ".join(f"(length(low) - length(replace(low, {_quoted([c])}, ''))) // {len(c)}" for c in lexicon.CONTRACTIONS)
    return f"""
d AS ({source}),
s0 AS (SELECT k, t, list_filter(list_transform(regexp_split_to_array(t, '[.!?]+[\\t\\n\\f\\r ]+'), lambda s: regexp_replace(s, '{OUTER}', '', 'g')), lambda s: s <> '') AS ss FROM d),
sent AS (SELECT k, unnest(ss) AS s, generate_subscripts(ss, 1) AS si FROM s0),
sw AS (SELECT k, si, s, {words_of("s")} AS ws FROM sent),
tw AS (SELECT k, {words_of("t")} AS ws FROM d),
tok AS (SELECT k, unnest(ws) AS w, lower(unnest(ws)) AS lw, generate_subscripts(ws, 1) AS pos FROM tw),
syl AS (SELECT *, greatest(1, v - CASE WHEN ends_with(lw, 'e') AND v > 1 THEN 1 ELSE 0 END) AS syllables FROM (SELECT *, len(regexp_extract_all(lw, '[aeiouy]+')) AS v FROM tok)),
n AS (SELECT d.k, d.t, lower(d.t) AS low, len(ws) AS n_words, len(ss) AS n_sentences FROM d JOIN tw USING (k) JOIN s0 USING (k)),
sl AS (SELECT k, CASE WHEN avg(len(ws)) > 0 THEN stddev_pop(len(ws)) / avg(len(ws)) ELSE 0 END AS cv, sum(len(ws)) AS words FROM sw GROUP BY k),
sentence_variance AS (SELECT n.k, CASE WHEN n_sentences < 3 THEN 0.5::DOUBLE ELSE 1 - least(cv / 0.5::DOUBLE, 1) END AS x FROM n LEFT JOIN sl USING (k)),
vocabulary AS (SELECT k, count(DISTINCT lw) AS u, count(DISTINCT CASE WHEN lw NOT IN ({common}) AND strlen(lw) > 3 THEN lw END) AS rare FROM tok GROUP BY k),
vocabulary_richness AS (SELECT n.k, CASE WHEN n_words < 10 THEN 0.5::DOUBLE ELSE greatest(0, least(1, (1 - least(u / n_words / 0.6::DOUBLE, 1)) * 0.6::DOUBLE + (1 - rare / u) * 0.4::DOUBLE)) END AS x FROM n LEFT JOIN vocabulary USING (k)),
gaps AS (SELECT k, lw, pos - lag(pos) OVER (PARTITION BY k, lw ORDER BY pos) AS gap FROM tok WHERE strlen(lw) > 4 AND lw NOT IN ({common})),
bursts AS (SELECT k, avg(cv) AS cv FROM (SELECT k, lw, stddev_pop(gap) / avg(gap) AS cv FROM gaps WHERE gap IS NOT NULL GROUP BY k, lw) GROUP BY k),
burstiness AS (SELECT n.k, CASE WHEN n_words < 20 OR cv IS NULL THEN 0.5::DOUBLE ELSE 1 - least(cv / 1.5::DOUBLE, 1) END AS x FROM n LEFT JOIN bursts USING (k)),
marks AS (SELECT k, regexp_extract_all(t, '\\p{{P}}') AS m FROM d),
punctuation_variety AS (SELECT k, CASE WHEN len(m) < 5 THEN 0.5::DOUBLE ELSE greatest(0, least(1, 1 - (len(list_distinct(m)) / 8 * 0.5::DOUBLE + len(list_filter(['!', '?', ';', ':', '-', '—', '(', ')', '"', ''''], lambda c: list_contains(m, c))) / 5 * 0.5::DOUBLE))) END AS x FROM marks),
phrases(ord, pattern, weight) AS (VALUES {phrases}),
hits AS (SELECT k, list(pattern ORDER BY ord) AS found, sum(weight) AS weight FROM n JOIN phrases ON contains(low, pattern) GROUP BY k),
phrase_score AS (SELECT n.k, coalesce(found, []) AS found, CASE WHEN weight IS NULL THEN 0::DOUBLE WHEN n_words = 0 THEN 1 ELSE least(weight / (n_words / 100), 1) END AS x FROM n LEFT JOIN hits USING (k)),
lengths AS (SELECT k, stddev_pop(strlen(w)) / avg(strlen(w)) AS cv, sum(strlen(w)) AS bytes FROM tok GROUP BY k),
word_length_variance AS (SELECT n.k, CASE WHEN n_words < 10 THEN 0.5::DOUBLE ELSE 1 - least(cv / 0.6::DOUBLE, 1) END AS x FROM n LEFT JOIN lengths USING (k)),
contractions_usage AS (SELECT k, CASE WHEN n_words < 20 THEN 0.5::DOUBLE ELSE 1 - least(({contractions}) / (n_words / 100) / 3, 1) END AS x FROM n),
starts AS (SELECT k, lower(ws[1] || ' ' || ws[2]) AS start, count(*) AS c FROM sw WHERE len(ws) >= 2 GROUP BY ALL),
repetition_score AS (SELECT n.k, CASE WHEN n_sentences < 3 THEN 0.5::DOUBLE ELSE least(coalesce(r, 0) / n_sentences * 2, 1) END AS x FROM n LEFT JOIN (SELECT k, sum(c - 1) AS r FROM starts GROUP BY k) USING (k)),
grams AS (
  SELECT k, 2 AS size, lw || ' ' || lead(lw, 1) OVER w AS g FROM tok WINDOW w AS (PARTITION BY k ORDER BY pos)
  UNION ALL SELECT k, 3, lw || ' ' || lead(lw, 1) OVER w || ' ' || lead(lw, 2) OVER w FROM tok WINDOW w AS (PARTITION BY k ORDER BY pos)),
gram_counts AS (SELECT k, size, g, count(*) AS c FROM grams WHERE g IS NOT NULL GROUP BY ALL),
gram_shares AS (SELECT *, c / sum(c) OVER (PARTITION BY k, size) AS p FROM gram_counts),
gram_stats AS (SELECT k, size, -sum(p * log2(p)) AS entropy, count(*) AS kinds, count(*) FILTER (c > 1) AS repeated FROM gram_shares GROUP BY k, size),
gram_both AS (SELECT k, avg(CASE WHEN kinds > 1 THEN entropy / log2(kinds) ELSE 0 END) AS e, avg(repeated / kinds) AS r FROM gram_stats GROUP BY k),
ngram_uniformity AS (SELECT n.k, CASE WHEN n_words < 15 THEN 0.5::DOUBLE ELSE greatest(0, least(1, e * (1 - r * 0.5::DOUBLE))) END AS x FROM n LEFT JOIN gram_both USING (k)),
sentence_syl AS (SELECT k, si, sum(greatest(1, v - CASE WHEN ends_with(lw, 'e') AND v > 1 THEN 1 ELSE 0 END)) AS syllables FROM (SELECT k, si, lower(w) AS lw, len(regexp_extract_all(lower(w), '[aeiouy]+')) AS v FROM (SELECT k, si, unnest(ws) AS w FROM sw)) GROUP BY k, si),
chunks AS (
  SELECT sw.k, (si - 1) // CASE WHEN n_sentences > 10 THEN 3 ELSE 2 END AS chunk, sum(len(ws)) AS words, coalesce(sum(syllables), 0) AS syllables,
         count(*) FILTER (regexp_replace(regexp_replace(s, '[.!?]+$', ''), '{OUTER}', '', 'g') <> '') AS alive
  FROM sw JOIN n USING (k) LEFT JOIN sentence_syl USING (k, si) GROUP BY ALL),
grades AS (SELECT k, CASE WHEN words = 0 OR alive = 0 THEN 0 ELSE greatest(0, least(18, 0.39::DOUBLE * (words / alive) + 11.8::DOUBLE * (syllables / words) - 15.59::DOUBLE)) END AS g FROM chunks),
grade_stats AS (SELECT k, count(*) AS c, stddev_pop(g) / avg(g) AS cv FROM grades WHERE g > 0 GROUP BY k),
readability_variance AS (SELECT n.k, CASE WHEN n_sentences < 4 OR coalesce(c, 0) < 2 THEN 0.5::DOUBLE ELSE 1 - least(cv / 0.3::DOUBLE, 1) END AS x FROM n LEFT JOIN grade_stats USING (k)),
totals AS (SELECT k, sum(syllables) AS syllables, count(*) FILTER (syllables >= 3 AND NOT ends_with(lw, 'ed') AND NOT ends_with(lw, 'es') AND NOT ends_with(lw, 'ing')) AS complex FROM syl GROUP BY k),
stats AS (
  SELECT n.k, CAST(strlen(t) AS BIGINT) AS char_count, n_words AS word_count, n_sentences AS sentence_count,
         CASE WHEN n_sentences > 0 THEN coalesce(words, 0) / n_sentences ELSE 0::DOUBLE END AS avg_sentence_len,
         CASE WHEN n_words > 0 THEN bytes / n_words ELSE 0::DOUBLE END AS avg_word_len,
         coalesce(u, 0) AS unique_words, CASE WHEN n_words > 0 THEN u / n_words ELSE 0::DOUBLE END AS unique_ratio,
         CAST(len(m) AS BIGINT) AS punctuation_count,
         CASE WHEN n_words = 0 OR n_sentences = 0 THEN 0::DOUBLE ELSE greatest(0, least(18, 0.39::DOUBLE * (n_words / n_sentences) + 11.8::DOUBLE * (syllables / n_words) - 15.59::DOUBLE)) END AS flesch_kincaid_grade,
         CASE WHEN n_words = 0 OR n_sentences = 0 THEN 0::DOUBLE ELSE greatest(0, least(20, 0.4::DOUBLE * (n_words / n_sentences + 100 * (complex / n_words)))) END AS gunning_fog_index
  FROM n LEFT JOIN sl USING (k) LEFT JOIN lengths USING (k) LEFT JOIN vocabulary USING (k) LEFT JOIN marks USING (k) LEFT JOIN totals USING (k))"""


DOCUMENTS = "SELECT doc_id AS k, coalesce(text, '') AS t FROM documents"
CONVERSATIONS = "SELECT conv_id * 100000 + turn AS k, coalesce(text, '') AS t FROM conversations"


def score(weights) -> str:
    total = " + ".join(f"{name}.x * {weight}::DOUBLE" for name, weight in zip(lexicon.SIGNALS, weights, strict=True))
    return f"greatest(0, least(1, ({total}) / ({' + '.join(f'{w}::DOUBLE' for w in weights)})))"


SIGNAL_JOINS = f"{lexicon.SIGNALS[0]} " + " ".join(f"JOIN {name} USING (k)" for name in lexicon.SIGNALS[1:])


def scored(source: str = DOCUMENTS, preset: str = "balanced") -> str:
    """base(source) and scored(k, ai_score)."""
    return f"{base(source)},\nscored AS (SELECT k, {score(lexicon.preset_weights(preset))} AS ai_score FROM {SIGNAL_JOINS})"
