"""DuckDB SQL for the registered queries: views as common table expressions, and one SELECT per query."""

from __future__ import annotations

import re

#: Views and intermediate results by name; each may use the ones above it.
VIEWS: dict[str, str] = {
    "ev": "SELECT event_id, user_id AS job_id, event_type, value, props, ts, epoch_us(ts) - 1704067200000000 AS us,"
    " (epoch_us(ts) - 1704067200000000) // 3600000 AS start_ms, CAST(round(value * 250) AS BIGINT) AS len_ms FROM events",
    "durations": "SELECT DISTINCT job_id, CAST(720000 AS BIGINT) AS duration_ms FROM ev",
    "silences": "SELECT job_id, start_ms, start_ms + len_ms AS end_ms FROM ev WHERE event_type IN ('error', 'signup')",
    "freezes": "SELECT job_id, start_ms, start_ms + len_ms AS end_ms FROM ev WHERE event_type IN ('view', 'click')",
    "scenes": "SELECT job_id, start_ms AS time_ms FROM ev WHERE event_type = 'click'",
    "highlights": "SELECT job_id, event_id AS idx, start_ms, start_ms + len_ms AS end_ms, value AS score, props AS reason,"
    " event_type AS recommended_use FROM ev WHERE event_type = 'purchase'",
    "vs": "SELECT job_id, greatest(0, start_ms) AS start_ms, least(duration_ms, end_ms) AS end_ms FROM silences JOIN durations USING (job_id)"
    " WHERE least(duration_ms, end_ms) > greatest(0, start_ms)",
    "vf": "SELECT job_id, greatest(0, start_ms) AS start_ms, least(duration_ms, end_ms) AS end_ms FROM freezes JOIN durations USING (job_id)"
    " WHERE least(duration_ms, end_ms) > greatest(0, start_ms)",
    "meets": "SELECT l.job_id, greatest(l.start_ms, r.start_ms) AS start_ms, least(l.end_ms, r.end_ms) AS end_ms FROM vs l JOIN vf r"
    " ON l.job_id = r.job_id AND l.start_ms < r.end_ms AND r.start_ms < l.end_ms",
    "either": "SELECT job_id, start_ms, end_ms, 'silence+freeze' AS reason FROM meets UNION ALL"
    " SELECT job_id, start_ms, end_ms, 'silence' FROM vs WHERE job_id NOT IN (SELECT job_id FROM vf)",
    "reach": "SELECT *, max(end_ms) OVER (PARTITION BY job_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM either",
    "isle": "SELECT *, sum(CASE WHEN start_ms <= reached + 120 THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY start_ms, end_ms"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM reach",
    "invalid": "SELECT job_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(reason) AS reason FROM isle GROUP BY job_id, island"
    " HAVING max(end_ms) - min(start_ms) >= 350",
    "padded": "SELECT job_id, start_ms, end_ms, reason, duration_ms, least(duration_ms, end_ms + 175) AS pend FROM invalid JOIN durations USING (job_id)",
    "pieces": "SELECT job_id, coalesce(lag(pend) OVER (PARTITION BY job_id ORDER BY start_ms, end_ms), 0) AS start_ms, greatest(0, start_ms - 175) AS end_ms,"
    " 'before ' || reason AS reason FROM padded UNION ALL SELECT job_id, arg_max(pend, start_ms), max(duration_ms), 'tail' FROM padded GROUP BY job_id",
    "kept": "SELECT * FROM pieces WHERE end_ms - start_ms >= 350 UNION ALL SELECT job_id, 0, duration_ms, 'full media' FROM durations"
    " WHERE job_id NOT IN (SELECT job_id FROM invalid)",
    "clips": "SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms) AS INTEGER) AS idx FROM kept",
    "gaps": "SELECT *, greatest(0, start_ms - lag(end_ms) OVER (PARTITION BY job_id ORDER BY idx)) AS gap FROM clips",
    "grp": "SELECT *, sum(CASE WHEN gap <= 1500 THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY idx) AS g FROM gaps",
    "merged": "SELECT job_id, min(start_ms) AS start_ms, arg_max(end_ms, idx) AS end_ms, count(*) AS n FROM grp GROUP BY job_id, g",
    "clip_scenes": "SELECT c.job_id, c.idx, count(*) AS scene_count, list(s.time_ms ORDER BY s.time_ms) AS scene_times FROM clips c JOIN scenes s"
    " ON c.job_id = s.job_id AND c.start_ms <= s.time_ms AND s.time_ms < c.end_ms JOIN durations d ON d.job_id = s.job_id AND s.time_ms <= d.duration_ms GROUP BY 1, 2",
    "njobs": "SELECT max(user_id) + 1 AS jobs FROM events",
    "lines": "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents",
    "untimed": "SELECT doc_id % jobs AS job_id, doc_id * 100000 + line AS seg_idx, text FROM lines, njobs",
    "shares": "SELECT u.job_id, seg_idx, text, duration_ms, greatest(300000, CAST(floor(CAST(duration_ms * 1000 * greatest(1, length(text)) AS DOUBLE)"
    " / sum(greatest(1, length(text))) OVER (PARTITION BY u.job_id)) AS BIGINT)) AS span FROM untimed u JOIN durations d ON d.job_id = u.job_id",
    "timed": "SELECT job_id, seg_idx, text, duration_ms, (upto - span + 500) // 1000 AS start_ms, (upto + 500) // 1000 AS end_ms FROM"
    " (SELECT *, CAST(sum(span) OVER (PARTITION BY job_id ORDER BY seg_idx) AS BIGINT) AS upto FROM shares)",
    "cleaned": "SELECT job_id, seg_idx, start_ms, CASE WHEN least(end_ms, duration_ms) <= start_ms THEN least(duration_ms, start_ms + 300)"
    " ELSE least(end_ms, duration_ms) END AS end_ms, trim(text, ' ' || chr(9) || chr(13) || chr(10)) AS text FROM timed"
    " WHERE trim(text, ' ' || chr(9) || chr(13) || chr(10)) <> '' AND start_ms < duration_ms",
    "segments": "SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY start_ms, seg_idx) - 1 AS INTEGER) AS seg_idx, start_ms, end_ms, text FROM cleaned",
    "wraw": "SELECT job_id, seg_idx, start_ms, end_ms, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS word_idx FROM segments",
    "wlen": "SELECT *, sum(length(word)) OVER (PARTITION BY job_id, seg_idx ORDER BY word_idx) AS upto, sum(length(word)) OVER (PARTITION BY job_id, seg_idx) AS total FROM wraw WHERE word <> ''",
    "words": "SELECT job_id, seg_idx, CAST(word_idx AS INTEGER) AS word_idx, start_ms + CAST(floor(CAST((end_ms - start_ms) * (upto - length(word)) AS DOUBLE) / total) AS BIGINT) AS w_start,"
    " start_ms + CAST(floor(CAST((end_ms - start_ms) * upto AS DOUBLE) / total) AS BIGINT) AS w_end, word FROM wlen",
    "seg_hit": "SELECT c.job_id, c.idx, c.start_ms AS cs, c.end_ms AS ce, s.seg_idx, s.start_ms AS ss, trim(s.text) AS text FROM clips c JOIN segments s ON c.job_id = s.job_id AND c.start_ms < s.end_ms AND s.start_ms < c.end_ms",
    "word_hit": "SELECT h.job_id, h.idx, h.seg_idx, string_agg(trim(w.word), '' ORDER BY w.word_idx) AS spoken FROM seg_hit h JOIN words w ON w.job_id = h.job_id AND w.seg_idx = h.seg_idx"
    " AND w.w_end > h.cs AND w.w_start < h.ce GROUP BY 1, 2, 3",
    "clip_raw": "SELECT h.job_id, h.idx, string_agg(coalesce(w.spoken, h.text), ' ' ORDER BY h.ss, h.seg_idx) FILTER (coalesce(w.spoken, h.text) <> '') AS t FROM seg_hit h LEFT JOIN word_hit w USING (job_id, idx, seg_idx) GROUP BY 1, 2",
    "clip_text": "SELECT job_id, idx, CASE WHEN length(t) <= 160 THEN t ELSE rtrim(substring(t, 1, 157)) || '...' END AS transcript_text FROM clip_raw",
    "full_clips": "SELECT c.job_id, c.idx, c.start_ms, c.end_ms, c.reason, coalesce(transcript_text, '') AS transcript_text, coalesce(scene_count, 0) AS scene_count, greatest(0.001, (c.end_ms - c.start_ms) / 1000.0) AS sec"
    " FROM clips c LEFT JOIN clip_text USING (job_id, idx) LEFT JOIN clip_scenes USING (job_id, idx)",
    "scored": "SELECT *, floor((least(1.0, length(transcript_text) / greatest(28.0::DOUBLE, sec * 7.0::DOUBLE)) * 0.55::DOUBLE + least(1.0, scene_count / greatest(1.0::DOUBLE, sec / 18.0::DOUBLE)) * 0.3::DOUBLE +"
    " (CASE WHEN sec BETWEEN 8 AND 75 THEN 1.0 WHEN sec BETWEEN 4 AND 120 THEN 0.55 ELSE 0.25 END)::DOUBLE * 0.15::DOUBLE) * 100 * 10 + 0.5) / 10 AS content_score FROM (SELECT * REPLACE (sec::DOUBLE AS sec) FROM full_clips)",
    "ranked": "SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY content_score DESC, idx) AS INTEGER) AS content_rank,"
    " CASE WHEN content_score >= 70 THEN 'strong_keep' WHEN content_score >= 42 THEN 'review' ELSE 'trim_candidate' END AS recommendation FROM scored",
    "hl": "SELECT job_id, idx, greatest(0, start_ms) AS start_ms, greatest(greatest(0, start_ms), end_ms) AS end_ms,"
    " floor(least(greatest(coalesce(score, 0), 0), 100) * 10 + 0.5) / 10 AS score, trim(coalesce(reason, '')) AS reason, recommended_use FROM highlights WHERE end_ms > greatest(0, start_ms)",
    "hl_hit": "SELECT c.job_id, c.idx, max(h.score) AS semantic_score, list(h.reason ORDER BY h.score DESC, h.start_ms, h.idx)[1:3] AS semantic_reasons FROM clips c JOIN hl h"
    " ON c.job_id = h.job_id AND c.start_ms < h.end_ms AND h.start_ms < c.end_ms GROUP BY 1, 2",
    "semantic": "SELECT r.job_id, r.idx, r.start_ms, r.end_ms, coalesce(semantic_score, 0) AS semantic_score, coalesce(semantic_reasons, []) AS semantic_reasons,"
    " CASE WHEN r.job_id IN (SELECT job_id FROM hl) THEN floor((content_score * 0.4::DOUBLE + coalesce(semantic_score, 0) * 0.6::DOUBLE) * 10 + 0.5) / 10 ELSE content_score END AS final_score FROM ranked r LEFT JOIN hl_hit USING (job_id, idx)",
    "semantic_ranked": "SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY final_score DESC, idx) AS INTEGER) AS final_rank FROM semantic",
    "timeline": "SELECT *, CAST(coalesce(sum(end_ms - start_ms) OVER (PARTITION BY job_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms FROM clips",
    "jobs": "SELECT 'job-' || o_orderkey AS job_name, 'src-' || o_custkey AS source_path, CASE WHEN o_orderpriority = '1-URGENT' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'done'"
    " WHEN o_orderstatus = 'O' THEN 'needs_review' ELSE 'transcribing' END AS status, o_custkey % 500 AS batch_id, o_orderdate AS updated_at, o_orderkey % 7 AS state_version FROM orders",
    "projects": "SELECT n_nationkey AS id, n_name AS name, n_regionkey = 0 AS archived, n_regionkey AS default_kit_id FROM nation",
    "revisions": "SELECT 'job-' || l_orderkey AS job_name, CASE WHEN l_returnflag = 'R' THEN 'cuts' ELSE 'transcript' END AS kind, l_shipdate AS created_at, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem",
    "stage_runs": "SELECT l_orderkey AS run_id, 'stage-' || l_linenumber AS stage, l_quantity AS duration_seconds, l_returnflag AS status, l_shipdate AS started_at, l_partkey AS seq FROM lineitem",
    "pref": "SELECT event_id AS id, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'clip_feedback' WHEN event_type = 'signup' THEN 'subtitle_correction' ELSE 'publish_selection' END AS kind, job_id,"
    " CASE event_type WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'rejected' WHEN 'error' THEN 'clear' END AS action, json_extract_string(props, '$.k') AS key, ts AS created_at, 'word-' || json_extract_string(props, '$.k') AS before, CASE WHEN event_id % 5 = 0 THEN 'word-' || json_extract_string(props, '$.k') ELSE 'fix-' || event_id % 7 END AS after, ['', 'a', 'b', 'c'][event_id % 4 + 1] AS platform FROM ev",
    "publish_steps": "SELECT l_partkey AS attempt_id, l_orderkey AS seq, l_linenumber, l_suppkey, ['draft', 'validating', 'uploading', 'processing', 'published', 'failed'][l_linenumber % 6 + 1] AS status,"
    " CAST(l_quantity AS BIGINT) AS uploaded_bytes, CAST(40 AS BIGINT) AS total_bytes FROM lineitem",
    "files": "SELECT 'job-' || p_partkey % 400 AS job_name, ['job.json', 'cuts.json', 'transcript.json', 'audio_16k.wav', 'final.mp4', 'render.tmp'][p_partkey % 6 + 1] AS name, CAST(p_size * 1000 AS BIGINT) AS size_bytes, p_partkey AS modified_at FROM part",
    "errors": "SELECT doc_id, text || chr(10) || CASE WHEN doc_id % 7 = 6 THEN '' ELSE ['CUDA out of memory', 'h264_nvenc failed to open', 'ffmpeg was not found', 'empty transcript', 'No space left on device', 'Error while decoding stream #0:0'][doc_id % 7 % 6 + 1] END AS text FROM documents",
    "chat": "SELECT conv_id AS job_id, turn AS seg_idx, text FROM conversations",
    "samples": "SELECT l_orderkey AS job_id, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS frame, l_suppkey % 2 AS channel,"
    " least(greatest(floor(l_extendedprice) - 32768, -32768), 32767) AS value FROM lineitem",
    "logev": "SELECT job_id, event_id, start_ms, len_ms, start_ms + len_ms AS end_ms, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM ev WHERE event_type IN ('error', 'signup')",
    "logmix": "SELECT job_id, start_ms * 2 AS pos, event_id, true AS opens, start_ms AS ms, 0 AS len FROM logev WHERE k % 10 <> 0 UNION ALL SELECT job_id, end_ms * 2 + 1, event_id, false, end_ms, len_ms FROM logev",
    "logs": "SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY pos, event_id) AS line_no FROM logmix",
}


def sql(select: str) -> str:
    """A SELECT with the views it uses, in order."""
    need: set[str] = set()

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                add(VIEWS[name])

    add(select)
    used = [n for n in VIEWS if n in need]
    return ("WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in used) + "\n" if used else "") + select
