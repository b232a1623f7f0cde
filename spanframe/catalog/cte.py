"""The adapters of ``fixtures.py`` as SQL common table expressions."""

CTE = {
    "spans": """SELECT CAST(user_id AS VARCHAR) AS source_id, event_id AS span_id, epoch_us(ts) AS start_us,
        epoch_us(ts) + CAST(round(value*100) AS BIGINT)*600000 AS end_us, event_type AS kind
        FROM events WHERE round(value*100) > 0""",
    "signals": """SELECT CAST(user_id AS VARCHAR) AS source_id, epoch_us(ts) AS t_us, event_id AS row_id, value, event_type AS kind FROM events""",
    "sources": """SELECT CAST(c_custkey AS VARCHAR) AS source_id, sha256(CAST(c_custkey AS VARCHAR)) AS sha256,
        CAST((c_nationkey+1)*12000000 AS BIGINT) AS duration_us, 1920 AS width, 1080 AS height,
        30000 AS fps_num, 1001 AS fps_den, c_nationkey % 5 <> 0 AS has_audio, c_custkey AS ord FROM customer""",
    "cues": """SELECT source_id, ord, source_id || ':' || ord AS cue_id, CAST(end_us - len AS BIGINT) AS start_us, CAST(end_us AS BIGINT) AS end_us, speaker, text FROM (
        SELECT CAST(conv_id AS VARCHAR) AS source_id, CAST(turn AS BIGINT) AS ord, role AS speaker, text, greatest(length(text),1)*60000 AS len,
        sum(greatest(length(text),1)*60000) OVER (PARTITION BY conv_id ORDER BY turn) AS end_us FROM conversations)""",
    "lines": """SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
        l_extendedprice, l_shipdate, l_discount, l_tax) AS ord FROM lineitem""",
    "clips": """SELECT CAST(l_orderkey AS VARCHAR) AS work_id, ord, l_orderkey || 'c' || ord AS clip_id,
        CAST(l_partkey % 50 AS VARCHAR) AS source_id, CAST(l_suppkey*250000 AS BIGINT) AS start_us,
        CAST(l_suppkey*250000 + CAST(l_quantity AS BIGINT)*400000 AS BIGINT) AS end_us,
        CAST(CASE WHEN l_returnflag='N' THEN 3 ELSE 1 END AS BIGINT) AS speed_num,
        CAST(CASE WHEN l_returnflag='A' THEN 1 ELSE 2 END AS BIGINT) AS speed_den,
        CAST(-round(l_discount*100) AS BIGINT) AS gain_db, l_linestatus='F' AS mute,
        CAST(30000 AS BIGINT) AS fps_num, CAST(1001 AS BIGINT) AS fps_den FROM lines""",
    "segments": """SELECT CAST(o_custkey AS VARCHAR) AS work_id,
        row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS ord,
        CAST(o_orderkey AS VARCHAR) AS segment_id, CAST(o_orderkey % 25 AS VARCHAR) AS beat_id,
        CASE WHEN o_orderstatus='F' THEN 'original' ELSE 'voiceover' END AS mode, o_orderpriority AS text,
        (c % 20000 + 1000)*1000 AS planned_us,
        CASE WHEN o_orderstatus<>'F' AND c % 7 <> 0 THEN (c % 30000 + 500)*1000 END AS voice_us,
        o_orderkey % 11 = 0 AS allow_reuse
        FROM (SELECT *, CAST(round(o_totalprice*100) AS BIGINT) AS c FROM orders)""",
    "visuals": """SELECT CAST(o_custkey AS VARCHAR) AS work_id, CAST(l_orderkey AS VARCHAR) AS segment_id, ord,
        CAST(l_partkey % 50 AS VARCHAR) AS source_id, CAST(l_suppkey*250000 AS BIGINT) AS start_us,
        CAST(l_suppkey*250000 + CAST(l_quantity AS BIGINT)*400000 AS BIGINT) AS end_us, 'u' || l_partkey AS unit_id
        FROM lines JOIN orders ON o_orderkey = l_orderkey""",
    "units": """SELECT source AS source_id, CAST(doc_id AS VARCHAR) AS unit_id, doc_id*1000000 AS start_us,
        doc_id*1000000 + 4000000 + (doc_id*7919) % 12000000 AS end_us, text, (doc_id*37) % 100 AS motion,
        (doc_id*53) % 100 AS speech, lang FROM documents""",
    "beats": """SELECT CAST(item_id // 10 AS VARCHAR) AS work_id, CAST(item_id AS VARCHAR) AS beat_id, item_id AS ord, text FROM benchmark""",
    "beat_spans": """SELECT CAST(item_id // 10 AS VARCHAR) AS work_id, CAST(item_id AS VARCHAR) AS beat_id, 'src' || (item_id % 20) AS source_id,
        item_id*10000000 AS start_us, item_id*10000000 + 60000000 AS end_us FROM benchmark""",
    "candidates": """SELECT CAST(user_id AS VARCHAR) AS work_id, CAST(event_id AS VARCHAR) AS highlight_id, event_id AS ord,
        CAST(event_id % 3 AS VARCHAR) AS source_id, CAST(floor(epoch_us(ts)/60000000) AS BIGINT) AS start_us,
        CAST(floor(epoch_us(ts)/60000000) AS BIGINT) + v + 300 AS end_us, event_type AS type, 'p' || (event_id % 4) AS character,
        (v*7919 + event_id*104729) % 1000003 AS score, (event_id*31) % 100 AS confidence, (event_id*17) % 50 AS redundancy
        FROM (SELECT *, CAST(round(value*100) AS BIGINT) AS v FROM events)""",
    "samples": """SELECT CAST(vec_id AS VARCHAR) AS source_id, embedding AS x, label FROM embeddings""",
    "revisions": """SELECT work_id, ord AS seq, ord - 1 AS parent, sha256(segment_id || '|' || text || '|' || planned_us) AS digest,
        CASE WHEN mode='original' THEN 'restore' ELSE 'commit' END AS action, segment_id AS doc FROM segments""",
    "ledger": """SELECT CAST(l_orderkey AS VARCHAR) AS task_id, l_orderkey || '-' || (l_partkey % 40) AS event_key, ord AS seq,
        CAST(round(l_extendedprice*100) AS BIGINT)*10000 AS amount_micros,
        sha256((l_partkey % 40) || '|' || (l_suppkey % 3)) AS body_sha FROM lines""",
    "roster": """SELECT CAST(doc_id AS VARCHAR) AS case_id, source AS family, lang AS stratum, 'W' || (doc_id % 16) AS package,
        doc_id % 9 = 0 AS critical, doc_id % 10 <> 3 AS in_scope, doc_id % 4 = 1 AS full_production FROM documents""",
    "scores": """SELECT CAST(doc_id AS VARCHAR) AS case_id, 'r' || doc_id AS run_id, quality=1 AS scope_declared, toxic=0 AS routing_correct,
        quality=1 AND toxic=0 AS execution_accepted, quality=1 AND doc_id % 3 = 0 AS production_usable, quality=1 AS critical_pass FROM labels""",
}

NEEDS = {"clips": ["lines"], "visuals": ["lines"], "ledger": ["lines"], "revisions": ["segments"]}


def sql(body: str, *names: str) -> str:
    """``body`` behind the named expressions (``body`` may add more after ``,``)."""
    seen: list[str] = []
    for n in names:
        for m in [*NEEDS.get(n, []), n]:
            if m not in seen:
                seen.append(m)
    head = ",\n".join(f"{n} AS ({CTE[n]})" for n in seen)
    body = body.strip()
    return f"WITH {head}{', ' if not body.upper().startswith('SELECT') else ' '}{body}"
