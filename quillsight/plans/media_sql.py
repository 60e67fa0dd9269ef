"""DuckDB twins of the media queries: the inline items' bytes as a table, and every signal worked out from it in SQL.

What a file's metadata says is stated as facts, as the items were built with it (media_queries.items); everything else is computed from bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..operators import audio, image, video

#: item, has_exif, camera_make, has_gps, generated, screenshot
IMAGE_FACTS = (
    ("jpeg_exif", True, "Canon", True, False, False), ("jpeg_plain", False, "", False, False, True),
    ("png_generated", True, "", False, True, False), ("png_screenshot", False, "", False, False, True), ("gif", False, "", False, False, False),
)
#: item, sample_rate (null: from the stream header), channels, bit_depth, bitrate, duration, has_id3, encoder_name, is_ai_marked, has_recording
AUDIO_FACTS = (
    ("wav_tone", 16000, 1, 16, 0, 1.0, False, "PCM", False, False), ("wav_marked", 16000, 1, 16, 0, 0.5, False, "PCM", True, True), ("mp3", 44100, 2, 0, 128, 0.0, False, "", False, False),
    ("mp3_tagged", 44100, 2, 0, 128, 0.0, True, "LAME", False, True), ("flac", None, None, None, 0, 0.0, False, "", False, False), ("ogg", 0, 0, 0, 0, 0.0, False, "Vorbis", False, False),
    ("mp4", 0, 0, 0, 0, 0.0, False, "", False, False), ("mp4_zeros", 0, 0, 0, 0, 0.0, False, "", False, False),
)
#: item, format, has_audio, has_video, encoder_name, is_ai_marked
VIDEO_FACTS = (
    ("mp4", "mp4", True, True, "", False), ("mp4_zeros", "mp4", False, True, "", False), ("webm", "webm", True, True, "", False), ("avi", "avi", False, True, "", False),
)


def _value(x) -> str:
    if x is None:
        return "NULL"
    return f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)


def table(rows: Sequence[tuple], names: Sequence[str]) -> str:
    """The rows as a query; whole numbers are BIGINT."""
    values = ", ".join("(" + ", ".join(f"{x}::BIGINT" if type(x) is int else _value(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {values}) AS v({', '.join(names)})"


def _table(rows: Sequence[tuple], names: str) -> str:
    return table(rows, names.split(", "))


def bytes_of(items: Sequence[tuple[str, bytes]]) -> str:
    """len(item, n, h), by_(item, i, v and the three bytes after it), text_(item, t: the printable bytes in lower case)."""
    rows = ", ".join(f"('{name}', '{data.hex()}')" for name, data in items)
    return f"""
len AS MATERIALIZED (SELECT item, h, len(h) // 2 AS n FROM (VALUES {rows}) AS v(item, h)),
plain AS (SELECT item, i - 1 AS i, CAST('0x' || x AS INTEGER) AS v FROM (SELECT item, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (SELECT item, regexp_extract_all(h, '..') AS xs FROM len))),
by_ AS MATERIALIZED (SELECT *, lead(v) OVER w AS v1, lead(v, 2) OVER w AS v2, lead(v, 3) OVER w AS v3 FROM plain WINDOW w AS (PARTITION BY item ORDER BY i)),
text_ AS MATERIALIZED (SELECT item, lower(string_agg(CASE WHEN v BETWEEN 32 AND 126 THEN chr(v) ELSE '.' END, '' ORDER BY i)) AS t FROM by_ GROUP BY item)"""


def _score(weights: dict[str, float]) -> str:
    total, whole = " + ".join(f"{name} * {w}::DOUBLE" for name, w in weights.items()), " + ".join(f"{w}::DOUBLE" for w in weights.values())
    return f"greatest(0, least(1, ({total}) / ({whole})))"


PNG = """
png_walk AS (
  SELECT l.item, 8 AS pt, n, h FROM len l WHERE starts_with(h, '89504e470d0a1a0a')
  UNION ALL SELECT item, pt + 12 + CAST('0x' || substr(h, 2 * pt + 1, 8) AS BIGINT), n, h FROM png_walk WHERE pt + 12 <= n AND pt + 24 + CAST('0x' || substr(h, 2 * pt + 1, 8) AS BIGINT) <= n),
png_parts AS (SELECT item, pt, CAST('0x' || substr(h, 2 * pt + 1, 8) AS BIGINT) AS size, CAST(from_hex(substr(h, 2 * pt + 9, 8)) AS VARCHAR) AS type, n, h FROM png_walk WHERE pt + 12 <= n)"""

PNG_CHUNKS = PNG + """
SELECT item, type, size AS length, CAST('0x' || substr(h, 2 * (pt + 8 + size) + 1, 8) AS BIGINT) AS crc FROM png_parts WHERE pt + 12 + size <= n"""

IMAGES = PNG + f""",
image_facts AS ({_table(IMAGE_FACTS, "item, has_exif, camera_make, has_gps, generated, screenshot")}),
im AS (SELECT item, n, CASE WHEN starts_with(h, 'ffd8ff') THEN 'jpeg' WHEN starts_with(h, '89504e47') THEN 'png' ELSE 'other' END AS kind FROM len WHERE n >= 8 AND item IN (SELECT item FROM image_facts)),
scan AS (SELECT item, arg_min(i + 2 + v2 * 256 + v3, i) AS start FROM by_ JOIN im USING (item) WHERE kind = 'jpeg' AND v = 255 AND v1 = 218 AND i < n - 10 GROUP BY item),
off AS (SELECT item, n, kind, CASE kind WHEN 'jpeg' THEN coalesce(start, 100) WHEN 'png' THEN coalesce(idat + 8, 50) ELSE 100 END AS o
  FROM im LEFT JOIN scan USING (item) LEFT JOIN (SELECT item, min(pt) AS idat FROM png_parts WHERE type = 'IDAT' GROUP BY item) USING (item)),
smp AS MATERIALIZED (SELECT item, i - o AS j, v FROM by_ JOIN off USING (item) WHERE i >= o AND i < o + 10000),
shares AS (SELECT item, count(*) / sum(count(*)) OVER (PARTITION BY item) AS p FROM smp WHERE j < 5000 GROUP BY item, v),
ent AS (SELECT item, -sum(p * log2(p)) / 8 AS x FROM shares GROUP BY item),
hist AS (SELECT item, lim, k, coalesce(c, 0) AS c FROM off CROSS JOIN (VALUES (10000), (8000)) AS l(lim) CROSS JOIN (SELECT unnest(range(256)) AS k)
  LEFT JOIN (SELECT item, lim, v AS k, count(*) AS c FROM smp JOIN (VALUES (10000), (8000)) AS l(lim) ON j < lim GROUP BY ALL) USING (item, lim, k)),
near AS (SELECT *, lag(c, 2) OVER w AS a, lag(c) OVER w AS b, lead(c) OVER w AS d, lead(c, 2) OVER w AS e, sum(c) OVER (PARTITION BY item, lim) AS total,
  sum(c) OVER (PARTITION BY item, lim ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS around FROM hist WINDOW w AS (PARTITION BY item, lim ORDER BY k)),
centre AS (SELECT item, sum(k * c) / sum(c) AS mean FROM hist WHERE lim = 10000 GROUP BY item),
moment AS (SELECT item, mean, sqrt(sum((k - mean) ** 2 * c) / sum(c)) AS spread FROM hist JOIN centre USING (item) WHERE lim = 10000 GROUP BY item, mean),
skew AS (SELECT item, CASE WHEN spread > 0 THEN sum(((k - mean) / spread) ** 3 * c) / sum(c) ELSE 0 END AS skew FROM hist JOIN moment USING (item) WHERE lim = 10000 GROUP BY item, spread),
shape AS (SELECT item, count(*) FILTER (k BETWEEN 10 AND 245 AND c = 0) / 236 AS gaps, count(*) FILTER (k BETWEEN 2 AND 253 AND a + b + d + e > 0 AND c > (a + b + d + e) / 4 * 5) / 256 AS spikes FROM near WHERE lim = 10000 GROUP BY item),
steps AS (SELECT item, j, v - lag(v) OVER (PARTITION BY item ORDER BY j) AS s FROM smp WHERE j < 8000),
islands AS (SELECT item, count(*) AS size, max(j) AS last FROM (SELECT item, j, sum(CASE WHEN s <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY item ORDER BY j) AS g FROM steps) GROUP BY item, g),
band AS (SELECT item, (SELECT count(*) FROM islands x WHERE x.item = s.item AND size > 8 AND last < (SELECT max(j) FROM steps y WHERE y.item = s.item)) / (count(*) // 10) AS repeats, count(*) FILTER (abs(s.s) <= 2) / count(*) AS close FROM steps s GROUP BY item HAVING count(*) >= 10),
tops AS (SELECT item, k, around, total, k - lag(k) OVER (PARTITION BY item ORDER BY k) AS gap FROM near WHERE lim = 8000 AND k BETWEEN 2 AND 253 AND c > a AND c > b AND c > d AND c > e),
peak AS (SELECT item, count(*) AS n_peaks, sum(around) / any_value(total) AS held, count(gap) >= 2 AND stddev_pop(gap) < avg(gap) * 0.2::DOUBLE AS regular, count(*) FILTER (k % 16 = 0) AS round_ones FROM tops GROUP BY item),
color AS (SELECT item, CASE WHEN off.n < 2000 THEN 0.5::DOUBLE ELSE
  (CASE WHEN off.n - o < 2000 THEN 0.5::DOUBLE WHEN x < 0.5 THEN 0.75 WHEN x < 0.65 OR x > 0.97 THEN 0.6 WHEN x > 0.92 THEN 0.45 ELSE 0.35 END) * 0.25::DOUBLE
  + (CASE WHEN off.n - o < 3000 THEN 0.5::DOUBLE ELSE least(0.9, 0.4::DOUBLE + CASE WHEN gaps > 0.3 THEN 0.2 WHEN gaps > 0.15 THEN 0.1 ELSE 0 END + CASE WHEN spikes > 0.05 THEN 0.2 WHEN spikes > 0.02 THEN 0.1 ELSE 0 END + CASE WHEN abs(skew) > 1.5 THEN 0.1 ELSE 0 END) END) * 0.30::DOUBLE
  + (CASE WHEN off.n - o < 2000 THEN 0.5::DOUBLE ELSE least(0.85, 0.4::DOUBLE + CASE WHEN repeats > 0.2 THEN 0.25 WHEN repeats > 0.1 THEN 0.15 ELSE 0 END + CASE WHEN close > 0.7 THEN 0.15 ELSE 0 END) END) * 0.25::DOUBLE
  + (CASE WHEN off.n - o < 2000 THEN 0.5::DOUBLE ELSE least(0.85, 0.4::DOUBLE + CASE WHEN n_peaks > 20 THEN 0.15 ELSE 0 END + CASE WHEN held > 0.6 THEN 0.15 ELSE 0 END + CASE WHEN regular THEN 0.15 ELSE 0 END
      + CASE WHEN round_ones > n_peaks // 3 AND round_ones > 2 THEN 0.1 ELSE 0 END) END) * 0.20::DOUBLE END AS color
  FROM off LEFT JOIN ent USING (item) LEFT JOIN shape USING (item) LEFT JOIN skew USING (item) LEFT JOIN band USING (item) LEFT JOIN peak USING (item)),
cuts AS (SELECT item, unnest(range(1000, n - 256, n // 12))[1] AS pt FROM (SELECT item, n, [x] AS xs FROM im, unnest(range(1000)) u(x) WHERE FALSE)),
starts AS (SELECT item, pt, row_number() OVER (PARTITION BY item ORDER BY pt) AS k FROM (SELECT item, unnest(range(1000, n - 256, n // 12)) AS pt FROM im WHERE n >= 5000)),
alike AS (SELECT x.item, x.k AS a, y.k AS b, avg(CASE WHEN p.v = q.v THEN 1.0 ELSE 0.0 END) AS s FROM starts x JOIN starts y ON x.item = y.item AND x.k < y.k AND y.k <= 10
  JOIN by_ p ON p.item = x.item AND p.i BETWEEN x.pt AND x.pt + 255 JOIN by_ q ON q.item = x.item AND q.i = y.pt + p.i - x.pt GROUP BY ALL),
edge AS (SELECT item, CASE WHEN count(a) < 3 THEN 0.5::DOUBLE WHEN avg(CASE WHEN s > 0.9 THEN 1.0 ELSE 0.0 END) > 0.3 THEN 0.7 ELSE 0.4 END AS edge FROM im LEFT JOIN alike USING (item) GROUP BY item),
grain AS (SELECT item, (i - 500) // 16 AS g, var_pop(v) AS x FROM by_ JOIN im USING (item) WHERE n >= 2000 AND i >= 500 AND i < 500 + 62 * 16 GROUP BY ALL),
noise AS (SELECT item, CASE WHEN count(x) = 0 THEN 0.5::DOUBLE WHEN avg(x) < 10 THEN 0.7 WHEN stddev_pop(x) / (avg(x) + 1) > 2 THEN 0.6 ELSE 0.4 END AS noise FROM im LEFT JOIN grain USING (item) GROUP BY item),
dqt AS (SELECT item, min(i) AS pt FROM by_ JOIN im USING (item) WHERE v = 255 AND v1 = 219 AND i < n - 100 GROUP BY item),
quant AS (SELECT item, sum(v) AS total FROM dqt JOIN by_ USING (item) WHERE i BETWEEN pt + 5 AND pt + 68 GROUP BY item),
coded AS (SELECT item, i, v, v1, row_number() OVER (PARTITION BY item ORDER BY i) AS r FROM scan JOIN by_ USING (item) JOIN im USING (item) WHERE start < n - 1000 AND i >= start AND i < start + 5000),
coded_bits AS (SELECT item, -sum(p * log2(p)) AS bits FROM (SELECT item, count(*) / sum(count(*)) OVER (PARTITION BY item) AS p FROM coded GROUP BY item, v) GROUP BY item),
zero_runs AS (SELECT item, avg(size) AS zeros FROM (SELECT item, count(*) AS size FROM (SELECT item, i - row_number() OVER (PARTITION BY item ORDER BY i) AS g FROM coded WHERE v = 0) GROUP BY item, g) GROUP BY item),
stuffed AS (SELECT item, avg(CASE WHEN v1 = 0 THEN 1.0 ELSE 0.0 END) AS stuffed FROM coded WHERE v = 255 AND (item, i + 1) IN (SELECT (item, i) FROM coded) GROUP BY item),
coefficient AS (SELECT item, CASE WHEN bits IS NULL THEN 0.5::DOUBLE ELSE (CASE WHEN bits < 6.5 THEN 0.7 WHEN bits > 7.9 THEN 0.6 ELSE 0.4 END) * 0.4::DOUBLE + (CASE WHEN coalesce(zeros, 0) < 1.5 OR zeros > 8 THEN 0.6 ELSE 0.4 END) * 0.3::DOUBLE
  + (CASE WHEN stuffed IS NULL THEN 0.5 WHEN stuffed < 0.3 THEN 0.6 WHEN stuffed > 0.95 THEN 0.4 ELSE 0.5 END) * 0.3::DOUBLE END AS x FROM im LEFT JOIN coded_bits USING (item) LEFT JOIN zero_runs USING (item) LEFT JOIN stuffed USING (item)),
tables AS (
  SELECT item, (SELECT min(i) FROM by_ b WHERE b.item = im.item AND v = 255 AND v1 = 219) AS pt, 1 AS k FROM im WHERE kind = 'jpeg'
  UNION ALL SELECT t.item, (SELECT min(i) FROM by_ b WHERE b.item = t.item AND b.v = 255 AND b.v1 = 219 AND b.i >= t.pt + 2 + c.v2 * 256 + c.v3), k + 1 FROM tables t JOIN by_ c ON c.item = t.item AND c.i = t.pt JOIN len l ON l.item = t.item WHERE t.pt < l.n - 4),
doubled AS (SELECT im.item, CASE WHEN count(pt) FILTER (pt < n - 4) > 2 THEN 0.65::DOUBLE ELSE 0.5 END AS x FROM im LEFT JOIN tables ON tables.item = im.item GROUP BY im.item),
compression AS (SELECT im.item, CASE WHEN kind <> 'jpeg' THEN 0.5::DOUBLE ELSE (CASE WHEN total IS NULL THEN 0.5 WHEN total < 200 THEN 0.7 WHEN total > 3000 THEN 0.6 ELSE 0.4 END) * 0.3::DOUBLE + c.x * 0.4::DOUBLE + d.x * 0.3::DOUBLE END AS compression
  FROM im LEFT JOIN quant USING (item) JOIN coefficient c USING (item) JOIN doubled d USING (item)),
halves AS (SELECT im.item, avg(CASE WHEN p.v = q.v THEN 1.0 ELSE 0.0 END) AS s FROM im JOIN by_ p ON p.item = im.item AND p.i BETWEEN 100 AND 599 JOIN by_ q ON q.item = im.item AND q.i = n // 2 + p.i - 100 WHERE n >= 2000 AND n // 2 + 500 <= n GROUP BY im.item),
image_signals AS (SELECT item, greatest(0, least(1, 0.5::DOUBLE + CASE WHEN has_exif THEN -0.2 ELSE 0.2 END - CASE WHEN camera_make <> '' THEN 0.2 ELSE 0 END - CASE WHEN has_gps THEN 0.2 ELSE 0 END + CASE WHEN generated THEN 0.4 ELSE 0 END - CASE WHEN screenshot THEN 0.2 ELSE 0 END)) AS metadata,
  color, edge, noise, compression, CASE WHEN s IS NULL THEN 0.5::DOUBLE WHEN s > 0.7 THEN 0.7 ELSE 0.4 END AS symmetry
  FROM image_facts JOIN color USING (item) JOIN edge USING (item) JOIN noise USING (item) JOIN compression USING (item) LEFT JOIN halves USING (item)),
image_scores AS (SELECT *, {_score(image.WEIGHTS)} AS ai_score FROM image_signals)"""
IMAGES = IMAGES.replace("cuts AS (SELECT item, unnest(range(1000, n - 256, n // 12))[1] AS pt FROM (SELECT item, n, [x] AS xs FROM im, unnest(range(1000)) u(x) WHERE FALSE)),\n", "")


def signals(table: str, weights: dict[str, float], unreadable: Sequence[str] = ()) -> str:
    """item, ai_score, the signals, readable; items that can't be read have nulls."""
    rows = f"SELECT item, round(ai_score, 6) AS ai_score, {', '.join(f'round({w}, 6) AS {w}' for w in weights)}, TRUE AS readable FROM {table}"
    return " UNION ALL ".join([rows, *(f"SELECT '{item}', NULL, {', '.join('NULL' for _ in weights)}, FALSE" for item in unreadable)])


FRAMES = f"""
rates(k, bitrate) AS (VALUES {", ".join(f"({i}, {b})" for i, b in enumerate(audio.BITRATES))}),
frequencies(k, sample_rate) AS (VALUES {", ".join(f"({i}, {s})" for i, s in enumerate(audio.SAMPLE_RATES))}),
sync AS MATERIALIZED (SELECT by_.item, i, n, bitrate, sample_rate, (v2 >> 1) & 1 AS padding, v3 >> 6 AS channel_mode, 144 * bitrate * 1000 // nullif(sample_rate, 0) + ((v2 >> 1) & 1) AS size
  FROM by_ JOIN len USING (item) JOIN rates r ON r.k = v2 >> 4 JOIN frequencies f ON f.k = (v2 >> 2) & 3
  WHERE v = 255 AND v1 & 224 = 224 AND i < n - 4 AND (v1 >> 3) & 3 = 3 AND (v1 >> 1) & 3 = 1 AND bitrate > 0 AND sample_rate > 0),
frames AS (
  SELECT item, min(i) AS pt FROM sync GROUP BY item
  UNION ALL SELECT s.item, (SELECT min(i) FROM sync x WHERE x.item = s.item AND x.i >= s.i + CASE WHEN s.size > 0 AND s.i + s.size < s.n THEN s.size ELSE 1 END) FROM frames f JOIN sync s ON s.item = f.item AND s.i = f.pt),
mp3 AS MATERIALIZED (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.item ORDER BY i) AS k FROM sync s JOIN frames f ON f.item = s.item AND f.pt = s.i) WHERE k <= 500)"""

MP3_FRAMES = FRAMES + """
SELECT item, CAST(i AS BIGINT) AS "offset", CAST(bitrate AS BIGINT) AS bitrate, CAST(sample_rate AS BIGINT) AS sample_rate, padding = 1 AS padding, CAST(channel_mode AS BIGINT) AS channel_mode, CAST(size AS BIGINT) AS frame_size FROM mp3"""


def _holds(column: str, markers: Sequence[bytes | str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{m.decode() if isinstance(m, bytes) else m}')" for m in markers) + ")"


AUDIO = FRAMES + f""",
stated AS ({_table(AUDIO_FACTS, "item, sample_rate, channels, bit_depth, bitrate, duration, has_id3, encoder_name, is_ai_marked, has_recording")}),
flac AS (SELECT a.item, (a.v << 12) + (a.v1 << 4) + (a.v2 >> 4) AS sample_rate, ((a.v2 >> 1) & 7) + 1 AS channels, ((a.v2 & 1) << 4) + (a.v3 >> 4) + 1 AS bit_depth FROM by_ a WHERE i = 18),
audio_facts AS (SELECT s.item, coalesce(s.sample_rate, f.sample_rate) AS sample_rate, coalesce(s.channels, f.channels) AS channels, coalesce(s.bit_depth, f.bit_depth) AS bit_depth, bitrate, duration, has_id3, encoder_name, is_ai_marked, has_recording, n,
  CASE WHEN starts_with(h, '494433') OR starts_with(h, 'fff') THEN 'mp3' WHEN starts_with(h, '52494646') THEN 'wav' WHEN starts_with(h, '664c6143') THEN 'flac' ELSE 'other' END AS kind FROM stated s JOIN flac f USING (item) JOIN len USING (item)),
mp3_score AS (SELECT item, CASE WHEN count(*) < 10 THEN 0.5::DOUBLE ELSE greatest(0, least(1, 0.5::DOUBLE + CASE WHEN (stddev_pop(bitrate) / avg(bitrate)) ** 2 < 0.01 THEN 0.1 WHEN (stddev_pop(bitrate) / avg(bitrate)) ** 2 > 0.3 THEN -0.1 ELSE 0 END
  + CASE WHEN avg(padding) < 0.01 OR avg(padding) > 0.99 THEN 0.05 WHEN avg(padding) > 0.3 AND avg(padding) < 0.7 THEN -0.05 ELSE 0 END + CASE WHEN avg(CASE WHEN size = before THEN 1.0 WHEN before IS NOT NULL THEN 0.0 END) > 0.99 THEN 0.1 ELSE 0 END
  + CASE WHEN avg(CASE WHEN channel_mode = 3 THEN 1.0 ELSE 0.0 END) * 0.1::DOUBLE > 0.3 THEN 0.1 WHEN avg(CASE WHEN channel_mode = 3 THEN 1.0 ELSE 0.0 END) * 0.1::DOUBLE < 0.05 THEN -0.05 ELSE 0 END)) END AS x
  FROM (SELECT *, lag(size) OVER (PARTITION BY item ORDER BY i) AS before FROM mp3) GROUP BY item),
body AS (SELECT b.item, min(b.i) + 8 AS pt FROM by_ b JOIN audio_facts a ON a.item = b.item AND kind = 'wav' WHERE b.i >= 12 AND b.v = 100 AND b.v1 = 97 AND b.v2 = 116 AND b.v3 = 97 GROUP BY b.item),
pcm AS MATERIALIZED (SELECT b.item, (i - pt) // 2 AS j, CASE WHEN v1 >= 128 THEN v + v1 * 256 - 65536 ELSE v + v1 * 256 END AS s, n - pt AS size FROM by_ b JOIN body USING (item) JOIN len USING (item) WHERE i >= pt AND (i - pt) % 2 = 0 AND v1 IS NOT NULL),
turns AS (SELECT item, j // 250 AS g, count(*) FILTER (j % 250 > 0 AND (s < 0) <> (before < 0)) / 250 AS rate FROM (SELECT *, lag(s) OVER (PARTITION BY item ORDER BY j) AS before FROM pcm) WHERE j < 250 * least(20, CAST(ceil((size - 500) / 500) AS BIGINT)) GROUP BY ALL),
wav_score AS (SELECT p.item, 0.5::DOUBLE + CASE WHEN abs(avg(s) FILTER (j < 10000) / 32768) < 0.001 THEN 0.05 ELSE 0 END - CASE WHEN avg(CASE WHEN s IN (32767, -32768) THEN 1.0 ELSE 0.0 END) FILTER (j < 10000) > 0.01 THEN 0.1 ELSE 0 END
  + CASE WHEN (SELECT var_pop(rate) FROM turns t WHERE t.item = p.item) < 0.1 THEN 0.05 ELSE 0 END AS x FROM pcm p GROUP BY p.item),
flac_score AS (SELECT item, CASE WHEN least(500, count(*) FILTER (i >= 42 AND i < n - 2 AND v = 255 AND v1 & 252 = 248)) BETWEEN 1 AND n // 4000 // 4 - 1 THEN 0.55::DOUBLE ELSE 0.5 END AS x FROM by_ JOIN len USING (item) GROUP BY item, n),
parts AS (SELECT item, 'a' AS part, v FROM by_ WHERE i < 500 UNION ALL SELECT item, 'b', v FROM by_ JOIN len USING (item) WHERE i >= n // 4 AND i < n // 4 + 2000),
part_bits AS (SELECT item, part, -sum(p * log2(p)) / 8 AS x FROM (SELECT item, part, count(*) / sum(count(*)) OVER (PARTITION BY item, part) AS p FROM parts GROUP BY item, part, v) GROUP BY item, part),
tails AS (SELECT item, substr(h, 2 * (n // 4) + 1) AS t, n - n // 4 AS m FROM len WHERE n >= 5000),
chunk_starts AS (SELECT item, t, m, unnest(range(0, m - 512, 256)) AS i FROM tails WHERE m >= 2000),
chunk_pairs AS (SELECT item, i, t, unnest(range(i + 256, least(m - 256, i + 2560), 256)) AS j FROM chunk_starts),
chunk_counts AS (SELECT item, i, count(*) AS pairs, count(*) FILTER (substr(t, 2 * i + 1, 512) = substr(t, 2 * j + 1, 512)) AS equal FROM chunk_pairs GROUP BY item, i),
chunk_sums AS (SELECT *, coalesce(sum(pairs) OVER (PARTITION BY item ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chunk_counts),
repeated AS (SELECT item, CASE WHEN sum(equal) / sum(pairs) > 0.1 THEN 0.15 ELSE 0 END AS x FROM chunk_sums WHERE before < 50 GROUP BY item),
generic_score AS (SELECT item, greatest(0, least(1, 0.5::DOUBLE + CASE WHEN abs(a.x - b.x) < 0.5 THEN 0.1 ELSE 0 END + coalesce(r.x, 0))) AS x FROM part_bits a JOIN part_bits b USING (item) LEFT JOIN repeated r USING (item) WHERE a.part = 'a' AND b.part = 'b'),
windows AS (SELECT p.item, (p.i - n // 3) // 100 AS g, avg(CASE WHEN p.v = q.v THEN 1.0 ELSE 0.0 END) AS s FROM by_ p JOIN len USING (item) JOIN by_ q ON q.item = p.item AND q.i = p.i + 100
  WHERE n >= 10000 AND p.i >= n // 3 AND p.i < n // 3 + least(5000, n - n // 3) - 200 AND (p.i - n // 3) // 100 < (least(5000, n - n // 3) - 200 + 99) // 100 GROUP BY ALL),
hum AS (SELECT item, count(*) FILTER (s > 0.9) AS n_alike FROM windows GROUP BY item),
audio_signals AS (SELECT a.item,
  greatest(0, least(1, 0.5::DOUBLE + CASE WHEN is_ai_marked THEN 0.35 ELSE 0 END - CASE WHEN has_recording THEN 0.2 ELSE 0 END - CASE WHEN has_id3 THEN 0.1 ELSE 0 END + CASE WHEN {_holds("lower(encoder_name)", audio.GENERATOR_TOOLS)} THEN 0.3 ELSE 0 END)) AS metadata,
  0.5::DOUBLE + CASE WHEN sample_rate > 0 AND sample_rate NOT IN {audio.STANDARD_RATES} THEN 0.1 ELSE 0 END + CASE WHEN sample_rate >= 96000 AND bit_depth >= 24 THEN 0.1 ELSE 0 END + CASE WHEN channels = 1 THEN 0.1 ELSE 0 END AS format,
  CASE WHEN n < 5000 THEN 0.5::DOUBLE WHEN kind = 'mp3' THEN m.x WHEN kind = 'wav' THEN w.x WHEN kind = 'flac' THEN f.x ELSE g.x END AS pattern,
  0.5::DOUBLE + CASE WHEN bitrate > 0 AND bitrate < 64 THEN 0.1 ELSE 0 END + CASE WHEN bitrate > 320 THEN 0.1 ELSE 0 END + CASE WHEN n < 10000 THEN 0.2 ELSE 0 END AS quality,
  least(1, CASE WHEN {_holds("substr(t, 1, 50000)", audio.SIGNATURES)} THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN is_ai_marked THEN 0.4 ELSE 0 END) AS signatures,
  CASE WHEN n < 10000 THEN 0.5::DOUBLE WHEN n_alike > 5 THEN 0.7 ELSE 0.4 END AS noise
  FROM audio_facts a JOIN text_ USING (item) LEFT JOIN mp3_score m USING (item) LEFT JOIN wav_score w USING (item) LEFT JOIN flac_score f USING (item) LEFT JOIN generic_score g USING (item) LEFT JOIN hum USING (item)),
audio_scores AS (SELECT *, {_score(audio.WEIGHTS)} AS ai_score FROM audio_signals)"""

AUDIO_METADATA = AUDIO + """
SELECT item, CASE WHEN kind = 'other' THEN CASE WHEN item = 'ogg' THEN 'ogg' ELSE 'm4a' END ELSE kind END AS format, CAST(sample_rate AS BIGINT) AS sample_rate, CAST(channels AS BIGINT) AS channels, CAST(bit_depth AS BIGINT) AS bit_depth,
  CAST(bitrate AS BIGINT) AS bitrate, duration, has_id3, encoder_name, is_ai_marked, has_recording FROM audio_facts"""

WAVE_STATS = AUDIO + """,
wave AS (SELECT item, j, s / 32768 AS x, lag(s / 32768) OVER (PARTITION BY item ORDER BY j) AS before FROM pcm),
w AS (SELECT item, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak, count(*) FILTER ((x < 0) <> (before < 0)) / count(*) AS zcr, avg(CASE WHEN abs(x) < 0.01 THEN 1.0 ELSE 0.0 END) AS silence,
  sum((x - before) ** 2) / sum(x * x) FILTER (before IS NOT NULL) AS high FROM wave GROUP BY item)
SELECT item, CAST(n AS BIGINT) AS file_size, round(silence, 6) AS silence_ratio, round(peak, 6) AS peak_amplitude, round(20 * log10(peak / rms), 6) AS dynamic_range, round(rms, 6) AS rms_amplitude, round(zcr, 6) AS zero_crossing_rate,
  round(zcr * 8000, 6) AS spectral_centroid, round(least(8000 * (0.2::DOUBLE + 0.6::DOUBLE * high), 8000), 6) AS spectral_rolloff, round(peak / rms, 6) AS crest FROM w JOIN len USING (item)"""


_UNITS = """
boxes AS (
  SELECT item, 0 AS pt, h, n FROM len WHERE starts_with(substr(h, 9), '66747970')
  UNION ALL SELECT item, pt + CAST('0x' || substr(h, 2 * pt + 1, 8) AS BIGINT), h, n FROM boxes WHERE pt < n - 8 AND CAST('0x' || substr(h, 2 * pt + 1, 8) AS BIGINT) >= 8),
mdat AS (SELECT item, min(pt) + 8 AS pt, arg_min(CAST('0x' || substr(h, 2 * pt + 1, 8) AS BIGINT), pt) - 8 AS size FROM boxes WHERE pt < n - 8 AND substr(h, 2 * pt + 9, 8) = '6d646174' GROUP BY item),
codes AS (SELECT b.item, m.pt, m.size, b.i - m.pt - CASE WHEN z.v = 0 AND b.i > m.pt THEN 1 ELSE 0 END AS start, b.i - m.pt + 3 AS body, b.v3 & 31 AS type
  FROM by_ b JOIN mdat m ON m.item = b.item LEFT JOIN by_ z ON z.item = b.item AND z.i = b.i - 1 WHERE b.v = 0 AND b.v1 = 0 AND b.v2 = 1 AND b.i >= m.pt AND b.i + 3 < m.pt + m.size),
units AS MATERIALIZED (SELECT item, pt, start, coalesce(lead(start) OVER w, size) - start AS size, type, row_number() OVER w - 1 AS k FROM codes WINDOW w AS (PARTITION BY item ORDER BY start))"""

VIDEO = _UNITS + f""",
video_facts AS ({_table(VIDEO_FACTS, "item, format, has_audio, has_video, encoder_name, is_ai_marked")}),
pictures AS (SELECT *, type = 5 AS key, row_number() OVER (PARTITION BY item ORDER BY k) - 1 AS f FROM units WHERE type IN (1, 5)),
intervals AS (SELECT item, count(*) AS n_keys, count(gap) AS n_gaps, var_pop(gap) AS spread, avg(gap) AS mean FROM (SELECT item, f - lag(f) OVER (PARTITION BY item ORDER BY f) AS gap FROM pictures WHERE key) GROUP BY item),
groups_ AS (SELECT item, count(*) AS n, stddev_pop(size) / avg(size) AS x FROM (SELECT item, f - coalesce(lag(f) OVER (PARTITION BY item ORDER BY f), 0) AS size FROM pictures WHERE key) WHERE size > 0 GROUP BY item),
sizes AS (SELECT item, count(*) AS n, count(*) FILTER (key) AS n_keys, stddev_pop(size) FILTER (key) / avg(size) FILTER (key) AS keys, count(*) FILTER (NOT key) AS n_others, stddev_pop(size) FILTER (NOT key) / avg(size) FILTER (NOT key) AS others FROM pictures GROUP BY item),
same_sizes AS (SELECT item, avg(CASE WHEN c > 1 THEN 1.0 ELSE 0.0 END) AS x FROM (SELECT item, size, count(*) AS c FROM pictures GROUP BY ALL) GROUP BY item),
mp4_score AS (SELECT s.item, CASE WHEN s.n < 5 THEN 0.5::DOUBLE ELSE greatest(0, least(1, 0.5::DOUBLE
  + CASE WHEN coalesce(i.n_keys, 0) < 2 THEN CASE WHEN s.n > 100 THEN 0.1 ELSE 0 END WHEN i.spread < 0.5 AND i.n_gaps > 3 THEN 0.05 WHEN i.spread > i.mean * 0.5 THEN -0.05 ELSE 0 END
  + CASE WHEN s.n >= 10 AND g.n > 3 AND g.x < 0.05 THEN 0.05 ELSE 0 END + CASE WHEN s.n < 10 THEN 0 ELSE CASE WHEN s.n_keys > 2 AND keys < 0.02 THEN 0.03 ELSE 0 END + CASE WHEN n_others > 5 AND others < 0.02 THEN 0.02 ELSE 0 END END
  + CASE WHEN s.n > 20 AND e.x > 0.5 THEN 0.05 ELSE 0 END)) END AS x FROM sizes s LEFT JOIN intervals i USING (item) LEFT JOIN groups_ g USING (item) LEFT JOIN same_sizes e USING (item)),
clusters AS (SELECT item, i, 9 - length(bin(first)) AS w, h FROM (SELECT b.item, b.i, CAST('0x' || substr(h, 2 * b.i + 9, 2) AS INTEGER) AS first, h FROM by_ b JOIN len l USING (item) WHERE b.v = 31 AND v1 = 67 AND v2 = 182 AND v3 = 117 AND b.i < n - 8) WHERE first > 0),
cluster_sizes AS (SELECT item, CAST('0x' || substr(h, 2 * i + 9, 2 * w) AS UBIGINT) & ((1::UBIGINT << (7 * w)::UBIGINT) - 1) AS size FROM clusters QUALIFY row_number() OVER (PARTITION BY item ORDER BY i) <= 100),
webm_score AS (SELECT item, CASE WHEN count(*) >= 3 AND stddev_pop(size) / avg(size) < 0.05 THEN 0.55::DOUBLE ELSE 0.5 END AS x FROM cluster_sizes WHERE size > 0 AND size < {video.MOST_CHUNK} GROUP BY item),
riff AS MATERIALIZED (SELECT b.item, b.i, CAST('0x' || substr(h, 2 * b.i + 15, 2) || substr(h, 2 * b.i + 13, 2) || substr(h, 2 * b.i + 11, 2) || substr(h, 2 * b.i + 9, 2) AS BIGINT) AS size, n, h FROM by_ b JOIN len USING (item)
  WHERE v = 48 AND v1 IN (48, 49) AND v2 = 100 AND v3 IN (98, 99) AND b.i < n - 8),
avi_score AS (SELECT item, CASE WHEN count(*) >= 5 AND stddev_pop(size) / avg(size) < 0.05 THEN 0.55::DOUBLE ELSE 0.5 END AS x FROM (SELECT * FROM riff WHERE size > 0 AND size < {video.MOST_CHUNK} QUALIFY row_number() OVER (PARTITION BY item ORDER BY i) <= 200) GROUP BY item),
video_signals AS (SELECT f.item,
  greatest(0, least(1, 0.5::DOUBLE + CASE WHEN is_ai_marked THEN 0.4 ELSE 0 END + CASE WHEN has_audio THEN 0 ELSE 0.15 END + CASE WHEN {_holds("lower(encoder_name)", video.GENERATOR_ENCODERS)} THEN 0.3 ELSE 0 END - CASE WHEN {_holds("lower(encoder_name)", video.EDITOR_ENCODERS)} THEN 0.1 ELSE 0 END)) AS metadata,
  CASE WHEN n < 1000 THEN 0.5::DOUBLE WHEN format = 'mp4' THEN 0.5::DOUBLE + CASE WHEN contains(substr(t, 1, 100000), 'moov') THEN 0 ELSE 0.2 END + CASE WHEN contains(t, 'mdat') THEN 0 ELSE 0.2 END WHEN format = 'webm' AND NOT contains(substr(h, 1, 2000), '18538067') THEN 0.7 ELSE 0.5 END AS container,
  CASE WHEN has_audio THEN 0.3::DOUBLE ELSE 0.7 END AS audio,
  CASE WHEN n < 10000 THEN 0.5::DOUBLE WHEN format = 'mp4' THEN coalesce(m.x, 0.5) WHEN format = 'webm' THEN coalesce(w.x, 0.5) ELSE coalesce(a.x, 0.5) END AS temporal,
  CASE WHEN {_holds("t", video.CODEC_TAGS)} THEN 0.45::DOUBLE WHEN format IN ('mp4', 'webm') THEN 0.6 ELSE 0.5 END AS encoding,
  CASE WHEN n < 100000 THEN 0.6::DOUBLE END AS bitrate
  FROM video_facts f JOIN len USING (item) JOIN text_ USING (item) LEFT JOIN mp4_score m USING (item) LEFT JOIN webm_score w USING (item) LEFT JOIN avi_score a USING (item)),
video_scores AS (SELECT *, {_score(video.WEIGHTS)} AS ai_score FROM video_signals),
blocks AS (SELECT item, i, CASE WHEN first = 0 THEN 0 ELSE 9 - length(bin(first)) END AS w, first, h, n FROM (SELECT b.item, b.i, b.v1 AS first, h, n FROM by_ b JOIN video_facts f USING (item) JOIN len USING (item) WHERE format = 'webm' AND b.v = 163 AND b.i < n - 10)),
sized AS (SELECT *, CAST(CAST('0x' || substr(h, 2 * i + 3, 2 * w) AS UBIGINT) & ((1::UBIGINT << (7 * w)::UBIGINT) - 1) AS BIGINT) AS size, i + 1 + CASE WHEN w BETWEEN 1 AND 4 THEN w ELSE 5 END AS start FROM blocks WHERE w > 0),
tracked AS (SELECT *, CASE WHEN CAST('0x' || substr(h, 2 * start + 1, 2) AS INTEGER) & 128 > 0 THEN 1 ELSE 2 END AS track FROM sized WHERE size > 0 AND size <= least({video.MOST_CHUNK}, n - i - 1) AND start + 4 <= n),
whole_blocks AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY item ORDER BY i) AS r FROM tracked WHERE start + track + 3 <= n),
whole_chunks AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY item ORDER BY i) AS r FROM riff JOIN video_facts USING (item) WHERE format = 'avi' AND size > 0 AND size <= {video.MOST_CHUNK} AND i + 8 + size <= n),
video_frames_ AS MATERIALIZED (
  SELECT item, k AS frame_index, type IN (5, 19, 20) AS key, u.pt + start AS "offset", u.size, substr(h, 2 * (u.pt + start) + 1, 2 * u.size) AS x FROM units u JOIN len USING (item) WHERE k < 1001
  UNION ALL SELECT item, r - 1, CAST('0x' || substr(h, 2 * (start + track + 2) + 1, 2) AS INTEGER) & 128 > 0, start, size, substr(h, 2 * start + 1, 2 * size) FROM whole_blocks
  UNION ALL SELECT item, r - 1, size > 50000 OR r = 1, i + 8, size, substr(h, 2 * i + 17, 2 * size) FROM whole_chunks)"""

#: Key frames of these items hold no parameter sets, so no frame hints at a resolution.
VIDEO_FRAMES = VIDEO + """
SELECT item, frame_index, CASE WHEN key THEN 'I' ELSE 'P' END AS frame_type, "offset", CAST(size AS BIGINT) AS size, sha256(from_hex(x)) AS data, 0::BIGINT AS width, 0::BIGINT AS height,
  CAST(size AS BIGINT) - lag(CAST(size AS BIGINT)) OVER (PARTITION BY item ORDER BY frame_index) AS size_delta FROM video_frames_ WHERE frame_index < 50"""

VIDEO_MOTION = VIDEO + """,
ten AS (SELECT item, frame_index AS f, CAST(size AS BIGINT) AS size, x FROM video_frames_ WHERE frame_index < 10),
fb AS MATERIALIZED (SELECT item, f, size, j, CAST('0x' || substr(x, 2 * j + 1, 2) AS INTEGER) AS v FROM (SELECT *, unnest(range(len(x) // 2)) AS j FROM ten)),
fe AS (SELECT item, f, round(-sum(p * log2(p)) / 8, 12) AS e FROM (SELECT item, f, count(*) / sum(count(*)) OVER (PARTITION BY item, f) AS p FROM fb GROUP BY item, f, v) GROUP BY item, f),
fm AS (SELECT item, f, any_value(size) AS size, avg(v) AS light FROM fb GROUP BY item, f),
per AS (SELECT item, f, size, light, e, size - lag(size) OVER w AS ds, e - lag(e) OVER w AS de FROM fm JOIN fe USING (item, f) WINDOW w AS (PARTITION BY item ORDER BY f)),
turned AS (SELECT item, avg(CASE WHEN (de > 0) <> (before > 0) THEN 1.0 ELSE 0.0 END) AS turns FROM (SELECT *, lag(de) OVER (PARTITION BY item ORDER BY f) AS before FROM per) WHERE before IS NOT NULL GROUP BY item),
changed AS (SELECT a.item, a.f, avg(CASE WHEN a.v <> b.v THEN 1.0 ELSE 0.0 END) AS c FROM fb a JOIN fb b ON b.item = a.item AND b.f = a.f + 1 AND b.j = a.j GROUP BY ALL),
change AS (SELECT item, avg(CASE WHEN c < 0.1 THEN 1.0 ELSE 0.0 END) AS smooth, var_pop(c) AS spread, count(*) AS pairs FROM changed GROUP BY item),
all_ AS (SELECT item, count(*) AS n, stddev_pop(size) / avg(size) AS by_size, stddev_pop(e) / avg(e) AS by_entropy, stddev_pop(light) / avg(light) AS light, var_pop(ds) AS ds FROM per GROUP BY item),
scored AS (SELECT v.item, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) < 2 THEN 0.5::DOUBLE ELSE greatest(0, least(1, 0.5::DOUBLE + CASE WHEN by_size < 0.1 THEN 0.1 WHEN by_size > 0.5 THEN -0.1 ELSE 0 END + CASE WHEN by_entropy < 0.05 THEN 0.1 WHEN by_entropy > 0.2 THEN -0.1 ELSE 0 END)) END AS consistency,
  CASE WHEN coalesce(n, 0) < 3 THEN 0.0::DOUBLE WHEN turns > 0.8 THEN 0.7 WHEN turns > 0.6 THEN 0.6 WHEN turns < 0.3 THEN 0.3 ELSE 0.5 END AS flickering, CASE WHEN coalesce(n, 0) < 3 THEN 0.0::DOUBLE WHEN light < 0.01 THEN 0.65 WHEN light > 0.3 THEN 0.6 WHEN light > 0.02 AND light < 0.15 THEN 0.35 ELSE 0.5 END AS lighting,
  CASE WHEN coalesce(n, 0) < 3 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE + CASE WHEN pairs >= 3 AND smooth > 0.7 THEN 0.1 ELSE 0 END + CASE WHEN pairs >= 3 AND ds < 1000 AND smooth > 0.5 THEN 0.1 ELSE 0 END END AS morphing,
  CASE WHEN coalesce(n, 0) < 3 THEN 0.0::DOUBLE ELSE spread END AS diff_variance FROM video_facts v LEFT JOIN all_ USING (item) LEFT JOIN turned USING (item) LEFT JOIN change USING (item))
SELECT item, CAST(n AS BIGINT) AS n_frames, round(consistency, 6) AS consistency, round(CASE WHEN n < 3 THEN 0.5 ELSE flickering * 0.25::DOUBLE + lighting * 0.20::DOUBLE + morphing * 0.25::DOUBLE + 0.30::DOUBLE * CASE WHEN diff_variance < 0.001 THEN 0.7 WHEN diff_variance < 0.01 THEN 0.6 WHEN diff_variance > 0.1 THEN 0.4 ELSE 0.5 END END, 6) AS overall,
  round(flickering, 6) AS flickering, round(diff_variance, 6) AS diff_variance, round(lighting, 6) AS lighting, round(morphing, 6) AS morphing FROM scored"""

#: Every item by its first bytes, as the router sees them: a container of type ftyp is a video, and heads of FLAC, Ogg, WebM and AVI are not in its table.
VERDICTS_TABLE = IMAGES + "," + AUDIO + "," + VIDEO + """,
verdicts AS (SELECT item, 'image' AS content_type, ai_score FROM image_scores UNION ALL SELECT 'jpeg_damaged', 'image', NULL
  UNION ALL SELECT item, 'audio', ai_score FROM audio_scores WHERE item NOT IN ('mp4', 'mp4_zeros', 'flac', 'ogg')
  UNION ALL SELECT item, 'video', ai_score FROM video_scores WHERE item IN ('mp4', 'mp4_zeros'))"""
VERDICTS = VERDICTS_TABLE + """
SELECT item, content_type, round(ai_score, 6) AS ai_score, round(ai_score, 9) < 0.5 AS human, round(abs(ai_score - 0.5) * 2, 6) AS confidence FROM verdicts"""

_STEPS = AUDIO + """,
tones AS MATERIALIZED (SELECT item, j, s / 32768 AS x FROM pcm),
hops AS (SELECT item, unnest(range(CASE WHEN count(*) < 8192 OR (count(*) - 4096) // 2048 < 2 THEN 1 ELSE least(50, (count(*) - 4096) // 2048) END)) AS f FROM tones GROUP BY item),
windowed AS MATERIALIZED (SELECT item, f, j - f * 2048 AS t, x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (j - f * 2048) / 4095)) AS x FROM tones JOIN hops USING (item) WHERE j >= f * 2048 AND j < f * 2048 + 4096),
waves AS MATERIALIZED (SELECT k AS a, cos(2 * pi() * k / 4096) AS c, sin(2 * pi() * k / 4096) AS s FROM (SELECT unnest(range(4096)) AS k)),
spectra AS MATERIALIZED (SELECT item, f, b, sqrt(sum(x * c) ** 2 + sum(x * s) ** 2) AS m FROM windowed CROSS JOIN (SELECT unnest(range(2048)) AS b) JOIN waves ON a = (t * b) % 4096 GROUP BY item, f, b),
step AS (SELECT item, b, m, b * 16000 / 4096::DOUBLE AS hz, sum(m * m) OVER (PARTITION BY item ORDER BY b) AS energy, sum(m * m) OVER (PARTITION BY item) AS whole FROM spectra WHERE f = 0),
"""
_STEPS = _STEPS.rstrip().rstrip(",")
SPECTRUM = _STEPS + """,
centre_ AS (SELECT item, sum(hz * m) / sum(m) AS centroid, exp(avg(ln(greatest(m, 1e-10)))) / avg(greatest(m, 1e-10)) AS flatness, min(hz) FILTER (energy >= whole * 0.85::DOUBLE) AS rolloff, sum(m * m) AS energy FROM step GROUP BY item),
wide AS (SELECT item, sqrt(sum((hz - centroid) ** 2 * m) / sum(m)) AS bandwidth FROM step JOIN centre_ USING (item) GROUP BY item),
root AS (SELECT item, arg_max(b, m) AS r, max(m) AS m FROM step WHERE b BETWEEN CAST(floor(80 / (16000 / 4096::DOUBLE)) AS INTEGER) AND CAST(floor(400 / (16000 / 4096::DOUBLE)) AS INTEGER) GROUP BY item),
over AS (SELECT item, k, max(s.m) AS p FROM root JOIN (SELECT unnest(range(2, 11)) AS k) ON TRUE JOIN step s USING (item) WHERE r * k < 2048 AND s.b BETWEEN greatest(0, r * k - 3) AND r * k + 3 GROUP BY item, k),
harmony AS (SELECT root.item, (any_value(root.m) ** 2 + sum(p * p)) / any_value(energy) AS harmonic_ratio FROM root JOIN over USING (item) JOIN centre_ USING (item) GROUP BY root.item),
rises AS (SELECT a.item, b_.f, sqrt(sum(greatest(b_.m - a.m, 0) ** 2)) AS x FROM spectra a JOIN spectra b_ ON b_.item = a.item AND b_.f = a.f + 1 AND b_.b = a.b GROUP BY ALL),
flux AS (SELECT c.item, coalesce((SELECT avg(x) FROM rises r WHERE r.item = c.item), 0) AS flux FROM centre_ c)
SELECT item, round(centroid, 6) AS centroid, round(flatness, 6) AS flatness, round(rolloff, 6) AS rolloff, round(bandwidth, 6) AS bandwidth, round(harmonic_ratio, 6) AS harmonic_ratio, round(flux, 6) AS flux
FROM centre_ JOIN wide USING (item) JOIN harmony USING (item) JOIN flux USING (item)"""

#: Peaks between 200 and 4,000 Hz that stand out, each six bins after the one before at least, five at most.
FORMANTS = _STEPS + """,
levels AS (SELECT item, avg(m) * 1.5::DOUBLE AS level FROM step WHERE b BETWEEN 51 AND 1024 GROUP BY item),
near_ AS (SELECT item, b, hz, m, greatest(lag(m, 2) OVER w, lag(m) OVER w, lead(m) OVER w, lead(m, 2) OVER w) AS beside FROM step WINDOW w AS (PARTITION BY item ORDER BY b)),
tops_ AS MATERIALIZED (SELECT item, b, hz FROM near_ JOIN levels USING (item) WHERE m > beside AND m > level AND b BETWEEN 53 AND 1021),
chosen AS (SELECT item, min(b) AS b, 0 AS place FROM tops_ GROUP BY item
  UNION ALL SELECT c.item, (SELECT min(t.b) FROM tops_ t WHERE t.item = c.item AND t.b >= c.b + 6), place + 1 FROM chosen c WHERE c.b IS NOT NULL AND place < 4)
SELECT item, place, round(hz, 6) AS hz FROM chosen JOIN tops_ USING (item, b)"""

#: Frames of 512 samples every 160, 26 filters, 13 coefficients, as for 16 kHz by default.
CEPSTRUM = AUDIO + """,
tones AS MATERIALIZED (SELECT item, j, s / 32768 AS x FROM pcm),
sharp AS MATERIALIZED (SELECT item, j, x - 0.97::DOUBLE * coalesce(lag(x) OVER (PARTITION BY item ORDER BY j), 0) AS x FROM tones),
hops AS (SELECT item, unnest(range(least(1000, (count(*) - 512) // 160))) AS f FROM tones GROUP BY item),
windowed AS MATERIALIZED (SELECT sharp.item, f, j - f * 160 AS t, x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (j - f * 160) / 511)) AS x FROM sharp JOIN hops ON hops.item = sharp.item AND j >= f * 160 AND j < f * 160 + 512),
waves AS MATERIALIZED (SELECT k AS a, cos(2 * pi() * k / 512) AS c, sin(2 * pi() * k / 512) AS s FROM (SELECT unnest(range(512)) AS k)),
power AS MATERIALIZED (SELECT item, f, b, sum(x * c) ** 2 + sum(x * s) ** 2 AS p FROM windowed CROSS JOIN (SELECT unnest(range(256)) AS b) JOIN waves ON a = (t * b) % 512 GROUP BY item, f, b),
mel AS (SELECT k, least(255, CAST(floor(700 * (10 ** (2595 * log10(1 + 8000 / 700::DOUBLE) * k / 27 / 2595) - 1) / (16000 / 512::DOUBLE)) AS INTEGER)) AS pt FROM (SELECT unnest(range(28)) AS k)),
filters AS (SELECT k, pt AS l, lead(pt) OVER (ORDER BY k) AS c, lead(pt, 2) OVER (ORDER BY k) AS r FROM mel),
weights AS (SELECT k, b, CASE WHEN b >= c AND b < r THEN (r - b) / greatest(1, r - c) WHEN b >= l AND b < c THEN (b - l) / greatest(1, c - l) ELSE 0 END AS w FROM filters CROSS JOIN (SELECT unnest(range(256)) AS b) WHERE k < 26),
energies AS (SELECT item, f, k, ln(greatest(sum(p * w), 1e-10)) AS e FROM power JOIN weights USING (b) GROUP BY item, f, k),
coefficients AS MATERIALIZED (SELECT item, f, q, sum(e * cos(pi() * q * (2 * k + 1) / 52)) * CASE WHEN q = 0 THEN sqrt(1 / 26::DOUBLE) ELSE sqrt(2 / 26::DOUBLE) END AS x FROM energies CROSS JOIN (SELECT unnest(range(13)) AS q) GROUP BY item, f, q),
ends AS (SELECT item, max(f) AS last FROM hops GROUP BY item),
moving AS (SELECT c.item, c.f, c.q, ((p.x - m.x) + 2 * (pp.x - mm.x)) / 10 AS d FROM coefficients c JOIN ends USING (item) JOIN coefficients p ON p.item = c.item AND p.q = c.q AND p.f = least(last, c.f + 1) JOIN coefficients m ON m.item = c.item AND m.q = c.q AND m.f = greatest(0, c.f - 1)
  JOIN coefficients pp ON pp.item = c.item AND pp.q = c.q AND pp.f = least(last, c.f + 2) JOIN coefficients mm ON mm.item = c.item AND mm.q = c.q AND mm.f = greatest(0, c.f - 2)),
by_column AS (SELECT item, q, avg(x) AS mean, var_pop(x) AS variance FROM coefficients GROUP BY item, q),
tails_ AS (SELECT item, q, avg((x - mean) ** 4) / any_value(variance) ** 2 - 3 AS kurtosis FROM coefficients JOIN by_column USING (item, q) GROUP BY item, q),
speeds AS (SELECT item, q, var_pop(d) AS v FROM moving GROUP BY item, q),
scored_ AS (SELECT b.item, round(0.5::DOUBLE + CASE WHEN avg(variance) FILTER (b.q BETWEEN 1 AND 5) < 10 THEN 0.1 WHEN avg(variance) FILTER (b.q BETWEEN 1 AND 5) > 50 THEN -0.1 ELSE 0 END
  + CASE WHEN avg(v) FILTER (b.q BETWEEN 1 AND 5) < 1 THEN 0.1 ELSE 0 END + CASE WHEN avg(abs(kurtosis)) FILTER (b.q BETWEEN 1 AND 5) < 0.5 THEN 0.05 ELSE 0 END, 6) AS mfcc_score
FROM by_column b JOIN tails_ t ON t.item = b.item AND t.q = b.q JOIN speeds s ON s.item = b.item AND s.q = b.q GROUP BY b.item)
SELECT item, CAST(q AS BIGINT) AS place, round(mean, 6) AS mfcc_mean, mfcc_score FROM by_column JOIN scored_ USING (item)"""
