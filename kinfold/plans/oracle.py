"""DuckDB SQL for the contact queries, built from one chain of common table expressions."""

from __future__ import annotations

from kinfold.functions.similarity import LONG_FORM
from kinfold.operators.calibration import BANDS
from kinfold.plans import rich
from kinfold.plans.resolution import DERIVED

_SHORT = ", ".join(f"('{k}', '{v}')" for k, v in LONG_FORM.items())

#: Each step may use all before it. The derived contacts have one e-mail, one phone, no middle names and no addresses.
STEPS: dict[str, str] = {
    "raw": DERIVED,
    "c0": """SELECT *, CASE WHEN regexp_matches(birthday, '^[0-9]{8}$') THEN concat(birthday[1:4], '-', birthday[5:6], '-', birthday[7:8])
        WHEN regexp_matches(birthday, '^[0-9]{2}/[0-9]{2}/[0-9]{4}$') THEN concat(split_part(birthday, '/', 3), '-', split_part(birthday, '/', 1), '-', split_part(birthday, '/', 2)) ELSE birthday END AS bd, concat_ws(' ', given_name, family_name) AS formatted_name FROM raw""",
    "c": "SELECT *, try_strptime(bd, '%Y-%m-%d') IS NOT NULL AND regexp_matches(bd, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AS ok FROM c0",
    "n": """SELECT idx, source, lower(strip_accents(family_name)) AS family, lower(strip_accents(given_name)) AS given, lower(family_name) AS sfamily, lower(given_name) AS sgiven,
        replace(lower(suffix), '.', '') AS generation, lower(trim(email)) AS email_key,
        CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) = 11 AND starts_with(regexp_replace(phone, '[^0-9]', '', 'g'), '1') THEN regexp_replace(phone, '[^0-9]', '', 'g')[2:] ELSE regexp_replace(phone, '[^0-9]', '', 'g') END AS phone_key,
        lower(trim(org)) AS org_key, bd, ok, concat(lower(strip_accents(given_name)), ' ', lower(strip_accents(family_name))) AS fullname, lower(strip_accents(given_name))[1:1] AS initial FROM c""",
    "g": """SELECT *, regexp_matches(email_key, '^[^@]+@[^.]+[.].+$') AS good_email, length(phone_key) >= 7 AND length(replace(phone_key, phone_key[1:1], '')) > 0 AS good_phone FROM n""",
    "sizes": "SELECT family, count(*) AS k FROM g WHERE family <> '' GROUP BY family",
    "pe": "SELECT x.idx AS a, y.idx AS b FROM g x JOIN g y ON x.email_key = y.email_key AND x.idx < y.idx WHERE x.email_key <> ''",
    "pp": "SELECT x.idx AS a, y.idx AS b FROM g x JOIN g y ON x.phone_key = y.phone_key AND x.idx < y.idx WHERE x.phone_key <> ''",
    "ps": "SELECT x.idx AS a, y.idx AS b FROM g x JOIN g y ON x.family = y.family AND x.idx < y.idx WHERE x.family IN (SELECT family FROM sizes WHERE k <= 50)",
    "pl": """SELECT x.idx AS a, y.idx AS b FROM g x JOIN g y ON x.family = y.family AND x.idx < y.idx WHERE x.family IN (SELECT family FROM sizes WHERE k > 50)
        AND ((x.initial <> '' AND x.initial = y.initial) OR (x.org_key <> '' AND x.org_key = y.org_key))""",
    "p": "SELECT * FROM pe UNION SELECT * FROM pp UNION SELECT * FROM ps UNION SELECT * FROM pl",
    "short": f"SELECT col0 AS k, col1 AS v FROM (VALUES {_SHORT})",
    "names": "SELECT DISTINCT fullname, concat(coalesce(v, split_part(fullname, ' ', 1)), fullname[length(split_part(fullname, ' ', 1)) + 1:]) AS longname FROM g LEFT JOIN short ON k = split_part(fullname, ' ', 1)",
    "f": """SELECT a, b, CASE WHEN x.fullname = y.fullname THEN 1.0 ELSE greatest(jaro_winkler_similarity(x.fullname, y.fullname), jaro_winkler_similarity(lx.longname, ly.longname)) END AS sim,
        x.family = y.family AND x.family <> '' AND x.given = y.given AND x.sgiven = y.sgiven AND x.sfamily = y.sfamily AND x.generation = y.generation AND NOT regexp_matches(x.given, '^[. ]*([^. ][. ]+)*[^. ]?$') AS name_exact,
        x.good_email AND x.email_key = y.email_key AS shared_email, x.good_phone AND x.phone_key = y.phone_key AS shared_phone, x.org_key <> '' AND x.org_key = y.org_key AS shared_org,
        x.ok AND y.ok AND x.bd = y.bd AND x.bd[6:] <> '01-01' AS shared_birthday, x.ok AND y.ok AND x.bd <> y.bd AS birthday_conflict,
        x.bd <> '' AND y.bd <> '' AND NOT (x.ok AND y.ok) AS birthday_unknown, x.given = '' OR y.given = '' AS nameless
        FROM p JOIN g x ON a = x.idx JOIN g y ON b = y.idx JOIN names lx ON lx.fullname = x.fullname JOIN names ly ON ly.fullname = y.fullname""",
    "s0": """SELECT *, least(sim * 0.4::DOUBLE + CASE WHEN shared_email THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN shared_phone THEN 0.25::DOUBLE ELSE 0 END
        + CASE WHEN shared_org THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN shared_birthday THEN 0.1::DOUBLE ELSE 0 END, 1.0::DOUBLE) AS score FROM f""",
    "s1": "SELECT *, score >= 0.85::DOUBLE OR (name_exact AND (shared_phone OR shared_email OR shared_birthday) AND NOT birthday_unknown) AS auto_ok FROM s0",
    "s": "SELECT *, CASE WHEN auto_ok AND NOT birthday_conflict THEN 'auto_merge' WHEN auto_ok OR score >= 0.6::DOUBLE OR sim >= 0.95::DOUBLE THEN 'review' ELSE 'distinct' END AS tier FROM s1",
    "near": "SELECT * FROM s WHERE tier = 'review' AND score < 0.6::DOUBLE AND NOT shared_phone AND NOT shared_email AND NOT shared_birthday",
    "ev": "SELECT a, b FROM s WHERE tier <> 'distinct' AND NOT (tier = 'review' AND score < 0.6::DOUBLE AND NOT shared_phone AND NOT shared_email AND NOT shared_birthday)",
    "arcs": "SELECT a AS u, b AS v FROM ev UNION SELECT b, a FROM ev",
    "reach": "SELECT u, u AS v FROM arcs UNION SELECT reach.u, arcs.v FROM reach JOIN arcs ON reach.v = arcs.u",
    "comp": "SELECT u AS idx, min(v) AS cluster FROM reach GROUP BY u",
    "free": """SELECT a, b, row_number() OVER (ORDER BY score DESC, CASE WHEN x.source <> y.source THEN 0 ELSE 1 END, a, b) AS k FROM near JOIN g x ON a = x.idx JOIN g y ON b = y.idx
        WHERE a NOT IN (SELECT idx FROM comp) AND b NOT IN (SELECT idx FROM comp)""",
    "greedy": """SELECT 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS a, NULL::BIGINT AS b UNION ALL
        SELECT e.k, CASE WHEN list_contains(taken, e.a) OR list_contains(taken, e.b) THEN taken ELSE list_concat(taken, [e.a, e.b]) END,
        CASE WHEN list_contains(taken, e.a) OR list_contains(taken, e.b) THEN NULL ELSE e.a END, CASE WHEN list_contains(taken, e.a) OR list_contains(taken, e.b) THEN NULL ELSE e.b END
        FROM greedy JOIN free e ON e.k = greedy.k + 1""",
    "matched": "SELECT a, b FROM greedy WHERE a IS NOT NULL",
    "placed": "SELECT idx, cluster FROM comp UNION ALL SELECT a, a FROM matched UNION ALL SELECT b, a FROM matched",
    "inside": "SELECT s.*, x.cluster FROM s JOIN placed x ON s.a = x.idx JOIN placed y ON s.b = y.idx AND x.cluster = y.cluster",
    "summ": """SELECT cluster, size, coalesce(pairs, 0) AS pairs, coalesce(lo, 1.0) AS min_score, hi AS max_score, coalesce(every AND 2 * pairs = size * (size - 1), false) AS auto
        FROM (SELECT cluster, count(*) AS size FROM placed GROUP BY cluster) LEFT JOIN (SELECT cluster, count(*) AS pairs, min(score) AS lo, max(score) AS hi, bool_and(tier = 'auto_merge') AS every FROM inside GROUP BY cluster) USING (cluster)""",
    "automem": "SELECT placed.* FROM placed JOIN summ USING (cluster) WHERE auto",
    "revmem": "SELECT placed.* FROM placed JOIN summ USING (cluster) WHERE NOT auto",
    "alone": "SELECT * FROM c WHERE idx NOT IN (SELECT idx FROM placed)",
    "ids": """SELECT cluster, sha256(string_agg(concat_ws(':', source, idx, family_name, given_name), '|' ORDER BY idx))[1:16] AS cluster_id FROM placed JOIN c USING (idx) GROUP BY cluster""",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, a, b) AS k FROM inside) WHERE k = 1",
    "grp": "SELECT c.idx, coalesce(cluster, c.idx) AS gr FROM c LEFT JOIN placed ON c.idx = placed.idx",
    "side": "SELECT gr, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS members FROM grp GROUP BY gr",
    "late": "SELECT least(x.gr, y.gr) AS ga, greatest(x.gr, y.gr) AS gb, max(score) AS score FROM near JOIN grp x ON a = x.idx JOIN grp y ON b = y.idx WHERE x.gr <> y.gr GROUP BY ALL",
    "lists": "SELECT * FROM placed",
    "ranked": "SELECT c.*, cluster, row_number() OVER (PARTITION BY cluster ORDER BY CASE WHEN source = 'icloud' THEN 0 ELSE 1 END, c.idx) AS k0 FROM placed JOIN c USING (idx)",
    "ordered": "SELECT *, CASE WHEN k0 = 1 THEN -1 ELSE idx END AS o FROM ranked",
    "emails": "SELECT cluster, string_agg(email, ';' ORDER BY email) AS emails FROM (SELECT cluster, arg_min(email, o) AS email FROM ordered GROUP BY cluster, lower(trim(email))) GROUP BY cluster",
    "phones": "SELECT cluster, string_agg(phone, ';' ORDER BY phone) AS phones FROM (SELECT cluster, arg_min(o.phone, o.o) AS phone FROM ordered o JOIN n USING (idx) WHERE phone_key <> '' GROUP BY cluster, phone_key) GROUP BY cluster",
    "mrg": """SELECT cluster, arg_min(idx, o) AS idx, arg_min(formatted_name, o) AS formatted_name, arg_min(family_name, o) AS family_name, arg_min(given_name, o) AS given_name,
        coalesce(arg_min(org, o) FILTER (org <> ''), '') AS org, coalesce(arg_min(bd, o) FILTER (bd <> ''), '') AS birthday, emails, phones, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS merged_from,
        CASE WHEN count(DISTINCT source) = 1 THEN min(source) WHEN arg_min(source, idx) = 'icloud' THEN 'icloud+google' ELSE 'google+icloud' END AS sources
        FROM ordered JOIN emails USING (cluster) JOIN phones USING (cluster) GROUP BY cluster, emails, phones""",
    "log": """SELECT event_id AS seq, user_id AS cluster_id, CASE event_type WHEN 'purchase' THEN 'merge' WHEN 'error' THEN 'undo' ELSE 'skip' END AS decision, (event_id % 101) / 100.0::DOUBLE AS score,
        CASE WHEN event_id % 2 = 0 THEN 'compact' ELSE 'detailed' END AS view_mode, CAST(floor(value * 100) AS BIGINT) AS decision_time_ms FROM events""",
    "rich": rich.FLAT,
    "held": """SELECT *, email_1 <> '' OR email_2 <> '' AS has_email, phone_1 <> '' OR phone_2 <> '' AS has_phone, street <> '' OR city <> '' AS has_address, org <> '' AS has_org, title <> '' AS has_title, url <> '' AS has_url,
        birthday <> '' AS has_birthday, note <> '' AS has_note, photo_uri <> '' AS has_photo, regexp_matches(email_1, '@.+[.]') OR regexp_matches(email_2, '@.+[.]')
        OR (phone_1 <> '' AND replace(regexp_replace(phone_1, '[^0-9]', '', 'g'), '0', '') <> '') OR phone_2 <> '' OR street <> '' AS reachable FROM rich""",
    "shown": f"""SELECT idx, source, family_name, given_name, middle_name, prefix, suffix, formatted_name, org, title, birthday, note, url, photo_uri, concat_ws(' ', CASE WHEN email_1 <> '' THEN 'WORK=' || email_1 END, CASE WHEN email_2 <> '' THEN '=' || email_2 END) AS emails,
        concat_ws(' ', CASE WHEN phone_1 <> '' THEN 'CELL=' || phone_1 END, CASE WHEN phone_2 <> '' THEN '=' || phone_2 END) AS phones, CASE WHEN street <> '' OR city <> '' THEN concat(street, '|', city) ELSE '' END AS addresses, tag FROM rich""",
    "readback": f"SELECT * REPLACE ({rich._SHOWN} AS formatted_name) FROM shown",
    "paired": "SELECT idx // 2 AS pair, *, CASE WHEN street <> '' OR city <> '' THEN concat(street, '|', city) ELSE '' END AS addresses FROM rich",
    "base": "SELECT * FROM paired WHERE source = 'icloud' OR pair NOT IN (SELECT pair FROM paired WHERE source = 'icloud')",
    "other": "SELECT * FROM paired WHERE idx NOT IN (SELECT idx FROM base)",
    "queue": """SELECT cluster, cluster_id, max_score AS score, lo_mode FROM (SELECT cluster, cluster_id, max_score, 1 AS lo_mode FROM summ JOIN ids USING (cluster) WHERE NOT auto)""",
    "state": "SELECT cluster, cluster_id, score, CASE cluster % 4 WHEN 0 THEN 'merge' WHEN 1 THEN 'skip' ELSE 'pending' END AS decision FROM queue",
    "bestrev": "SELECT best.* FROM best JOIN summ USING (cluster) WHERE NOT auto",
    "last": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY seq DESC) AS k FROM log) WHERE k = 1 AND decision <> 'undo'",
}
_FLAGS = "name_exact, shared_email, shared_phone, shared_org, shared_birthday, birthday_conflict, birthday_unknown, nameless"
_BAND = " ".join(f"WHEN score >= {lo}::DOUBLE AND score < {hi}::DOUBLE THEN '{name}'" for name, lo, hi in BANDS)
_OUT = "cluster, {kind} AS kind, idx, formatted_name, emails, phones"

FINAL: dict[str, str] = {
    "norm_contacts": "SELECT idx, family, given, sfamily AS strict_family, sgiven AS strict_given, generation, email_key AS email_keys, phone_key AS phone_keys, org_key, fullname AS \"full\", initial FROM g",
    "birthday_canonical": "SELECT idx, birthday AS raw, bd AS birthday, ok AS readable, ok AND bd[6:] <> '01-01' AS plausible FROM c",
    "plausibility": "SELECT idx, email_key AS email, phone_key AS phone, good_email, good_phone FROM g",
    "block_email": "SELECT * FROM pe",
    "block_phone": "SELECT * FROM pp",
    "block_family_small": "SELECT * FROM ps",
    "block_family_large": "SELECT * FROM pl",
    "candidate_pairs": "SELECT * FROM p",
    "scored_pairs": f"SELECT a, b, round(score, 6) AS score, tier, round(sim, 6) AS name_similarity, {_FLAGS} FROM s",
    "tier_counts": "SELECT tier, count(*) AS pairs FROM s GROUP BY tier",
    "evidence_components": "SELECT * FROM comp",
    "near_name_pairs": "SELECT * FROM matched",
    "cluster_summary": "SELECT cluster, size, pairs, round(min_score, 6) AS min_score, round(max_score, 6) AS max_score, auto FROM summ",
    "auto_clusters": "SELECT * FROM automem",
    "review_queue": """SELECT cluster, cluster_id, size, round(max_score, 6) AS score, round(min_score, 6) AS min_score,
        CASE WHEN size > 2 OR birthday_conflict OR birthday_unknown THEN 'detailed' WHEN max_score >= 0.6::DOUBLE THEN 'compact' ELSE 'detailed' END AS view_mode, 'pending' AS decision FROM summ JOIN best USING (cluster) JOIN ids USING (cluster) WHERE NOT auto""",
    "deferred_pairs": "SELECT round(score, 6) AS score, x.members AS side_a, y.members AS side_b FROM late JOIN side x ON x.gr = ga JOIN side y ON y.gr = gb",
    "distinct_contacts": "SELECT idx, formatted_name AS name FROM alone",
    "merged_contacts": """SELECT cluster, idx, round(min_score, 6) AS score, formatted_name, family_name, given_name, org, birthday, emails, phones, sources, merged_from FROM mrg JOIN summ USING (cluster) WHERE auto
        UNION ALL SELECT idx, idx, 0.0, formatted_name, family_name, given_name, org, bd, email, phone, source, idx::VARCHAR FROM alone""",
    "conflicts": """SELECT * FROM (SELECT x.cluster, unnest(['FN', 'ORG', 'BDAY']) AS field, unnest([x.formatted_name, x.org, x.bd]) AS icloud, unnest([y.formatted_name, y.org, y.bd]) AS other FROM
        (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY idx) AS k FROM ranked WHERE source = 'icloud') x JOIN (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY idx) AS k FROM ranked WHERE source <> 'icloud') y
        ON x.cluster = y.cluster AND x.k = 1 AND y.k = 1) WHERE icloud <> '' AND other <> '' AND icloud <> other""",
    "ambiguity": """SELECT cluster, a, b, concat('"', x.formatted_name, '" and "', y.formatted_name, '" scored ', printf('%.2f', score), ' (tier: ', tier, ')') AS said
        FROM inside JOIN c x ON a = x.idx JOIN c y ON b = y.idx WHERE cluster IN (SELECT cluster FROM revmem)""",
    "report_summary": """SELECT (SELECT count(*) FROM c WHERE source = 'icloud') AS total_icloud, (SELECT count(*) FROM c WHERE source = 'google') AS total_google, (SELECT count(*) FROM summ WHERE auto) AS auto_merged,
        (SELECT count(*) FROM summ WHERE NOT auto) AS needs_review, (SELECT count(*) FROM alone) AS distinct_contacts, (SELECT count(*) FROM late) AS deferred, 0::BIGINT AS warnings""",
    "resolve_output": f"""SELECT {_OUT.format(kind="'merged'")} FROM mrg WHERE cluster IN (SELECT cluster FROM automem) UNION ALL SELECT idx, 'distinct', idx, formatted_name, email, phone FROM alone
        UNION ALL SELECT {_OUT.format(kind="'resolved'")} FROM mrg WHERE cluster IN (SELECT cluster FROM revmem) AND cluster % 3 = 0
        UNION ALL SELECT cluster, 'pending', idx, formatted_name, email, phone FROM revmem JOIN c USING (idx) WHERE cluster % 3 = 2""",
    "last_decision": "SELECT cluster_id, seq, decision, score, view_mode, decision_time_ms FROM last",
    "calibration_counts": """SELECT count(*) AS total, count(*) FILTER (decision = 'merge') AS merges, count(*) FILTER (decision = 'skip') AS skips, coalesce(count(*) FILTER (decision = 'merge') * 100 // nullif(count(*), 0), 0) AS merge_rate,
        coalesce((sum(decision_time_ms) FILTER (view_mode = 'compact'))::BIGINT // nullif(count(*) FILTER (view_mode = 'compact'), 0), 0) AS avg_compact_ms,
        coalesce((sum(decision_time_ms) FILTER (view_mode = 'detailed'))::BIGINT // nullif(count(*) FILTER (view_mode = 'detailed'), 0), 0) AS avg_detailed_ms FROM last""",
    "calibration_bands": f"SELECT band, count(*) FILTER (decision = 'merge') AS merged, count(*) FILTER (decision = 'skip') AS skipped FROM (SELECT *, CASE {_BAND} END AS band FROM last) WHERE band IS NOT NULL GROUP BY band",
    "calibration_suggestion": """SELECT m AS min_merged, floor(m * 100) / 100 AS threshold, CASE WHEN greatest(floor(m * 100) / 100 - 0.05::DOUBLE, 0.5::DOUBLE) < floor(m * 100) / 100 THEN greatest(floor(m * 100) / 100 - 0.05::DOUBLE, 0.5::DOUBLE) END AS floor
        FROM (SELECT min(score) AS m FROM last WHERE decision = 'merge')""",
    "prune_split": "SELECT idx::INT AS idx, has_email, has_phone, has_address, has_org, has_title, has_url, has_birthday, has_note, has_photo, reachable FROM held",
    "prune_detail_counts": """SELECT count(*) AS removed, count(*) FILTER (has_email OR has_phone) AS uncounted, count(*) FILTER (has_org OR has_title) AS org_or_title, count(*) FILTER (has_url) AS url, count(*) FILTER (has_birthday) AS birthday,
        count(*) FILTER (NOT (has_email OR has_phone OR has_address OR has_org OR has_title OR has_url OR has_birthday OR has_note OR has_photo)) AS name_only FROM held WHERE NOT reachable""",
    "birthday_forms": f"SELECT idx, raw, canonical FROM ({rich.BIRTHDAYS})",
    "vcard_write": rich.CARD,
    "vcard_parse": "SELECT * FROM readback",
    "vcard_roundtrip": "SELECT * FROM readback",
    "merged_fields": """SELECT x.idx, x.source, x.prefix, x.suffix, """ + ", ".join(f"coalesce(nullif(x.{c}, ''), y.{c}, '') AS {c}" for c in ("family_name", "given_name", "middle_name", "formatted_name", "org", "title", "birthday", "note", "url", "photo_uri")) + """,
        array_to_string(list_transform(list_sort(list_filter([struct_pack(v := coalesce(x.email_1, ''), t := 'WORK'), struct_pack(v := coalesce(x.email_2, ''), t := ''), struct_pack(v := coalesce(y.email_1, ''), t := 'WORK'), struct_pack(v := coalesce(y.email_2, ''), t := '')], lambda e: e.v <> '')), lambda e: concat(e.t, '=', e.v)), ' ') AS emails,
        array_to_string(list_transform(list_sort(list_filter([struct_pack(v := coalesce(x.phone_1, ''), t := 'CELL'), struct_pack(v := coalesce(x.phone_2, ''), t := ''), struct_pack(v := coalesce(y.phone_1, ''), t := 'CELL'), struct_pack(v := coalesce(y.phone_2, ''), t := '')], lambda e: e.v <> '')), lambda e: concat(e.t, '=', e.v)), ' ') AS phones,
        concat_ws(' ', nullif(x.addresses, ''), nullif(y.addresses, '')) AS addresses, concat_ws(' ', nullif(x.tag, ''), nullif(y.tag, '')) AS tag,
        CASE WHEN y.idx IS NULL THEN x.source ELSE concat_ws('+', CASE WHEN x.idx < y.idx THEN x.source ELSE y.source END, CASE WHEN x.idx < y.idx THEN y.source ELSE x.source END) END AS sources FROM base x LEFT JOIN other y USING (pair)""",
    "generations": """SELECT idx, CASE WHEN suffix <> '' THEN lower(suffix) WHEN family_name LIKE '% Jr' THEN 'jr' ELSE '' END AS generation, (email_1 <> '')::BIGINT + (email_2 <> '')::BIGINT AS emails, (phone_1 <> '')::BIGINT + (phone_2 <> '')::BIGINT AS phones,
        regexp_matches(email_1, '@.+[.]')::BIGINT + (email_2 <> '')::BIGINT AS good_emails, (phone_1 <> '' AND phone_1 <> '000-0000')::BIGINT + (phone_2 <> '')::BIGINT AS good_phones FROM rich""",
    "review_breakdown": """SELECT cluster, concat('  Score breakdown:', chr(10), '    Name:     ', rpad(printf('%.2f', sim), 28, ' '), ' x0.40', chr(10), '    Email:    ', rpad(CASE WHEN shared_email THEN '1.00 (shared email)' ELSE '0.00 (no shared emails)' END, 28, ' '), ' x0.25', chr(10),
        '    Phone:    ', rpad(CASE WHEN shared_phone THEN '1.00 (shared phone)' ELSE '0.00 (no shared phones)' END, 28, ' '), ' x0.25', chr(10), '    Org:      ', rpad(CASE WHEN shared_org THEN '1.00 (shared org)' ELSE '0.00 (no shared org)' END, 28, ' '), ' x0.10', chr(10),
        '    Birthday: ', rpad(CASE WHEN birthday_conflict THEN '0.00 (birthdays differ)' WHEN birthday_unknown THEN '0.00 (a birthday could not be read)' WHEN shared_birthday THEN '1.00 (shared birthday)' ELSE '0.00 (no shared birthday)' END, 28, ' '), ' x0.10',
        CASE WHEN birthday_conflict THEN chr(10) || '    Held for review: the two birthdays disagree.' WHEN birthday_unknown THEN chr(10) || '    Held for review: a birthday could not be read, so they may disagree.' WHEN sim >= 0.95::DOUBLE AND score < 0.6::DOUBLE THEN chr(10) || '    Surfaced because the names match.' ELSE '' END) AS lines,
        concat(concat_ws(', ', printf('name %.2f x0.40', sim), CASE WHEN shared_email THEN 'email +0.25' END, CASE WHEN shared_phone THEN 'phone +0.25' END, CASE WHEN shared_org THEN 'org +0.10' END, CASE WHEN shared_birthday THEN 'birthday +0.10' END), printf(' = %.2f', score)) AS short FROM bestrev""",
    "review_evidence": """SELECT cluster, l.idx AS left_idx, l.formatted_name AS left_name, concat(CASE WHEN shared_email THEN '✓ ' ELSE '  ' END, l.email) AS left_email, concat(CASE WHEN shared_phone THEN '✓ ' ELSE '  ' END, l.tel) AS left_phone, l.org AS left_org, l.bd AS left_birthday,
        r.idx AS right_idx, r.formatted_name AS right_name, concat(CASE WHEN shared_email THEN '✓ ' ELSE '  ' END, r.email) AS right_email, concat(CASE WHEN shared_phone THEN '✓ ' ELSE '  ' END, r.tel) AS right_phone, r.org AS right_org, r.bd AS right_birthday
        FROM (SELECT *, CASE WHEN (SELECT source FROM c WHERE idx = a) <> 'icloud' AND (SELECT source FROM c WHERE idx = b) = 'icloud' THEN b ELSE a END AS li FROM bestrev) t
        JOIN (SELECT c.*, concat('(', phone_key[1:3], ') ', phone_key[4:6], '-', phone_key[7:10]) AS tel FROM c JOIN n USING (idx)) l ON l.idx = li JOIN (SELECT c.*, concat('(', phone_key[1:3], ') ', phone_key[4:6], '-', phone_key[7:10]) AS tel FROM c JOIN n USING (idx)) r ON r.idx = a + b - li""",
    "deferred_reasons": """SELECT x.members AS side_a, y.members AS side_b, concat('same name only: ', x.said, ' resembles ', y.said, ' by name, but one side is already merged on a shared identifier and a name alone does not join a cluster; both are in the output as separate people') AS reason
        FROM late JOIN (SELECT gr, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS members, concat(CASE WHEN count(*) > 1 THEN 'the merged cluster of ' ELSE '' END, string_agg(concat(formatted_name, ' (', source, ')'), ' + ' ORDER BY idx)) AS said FROM grp JOIN c USING (idx) GROUP BY gr) x ON x.gr = ga
        JOIN (SELECT gr, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS members, concat(CASE WHEN count(*) > 1 THEN 'the merged cluster of ' ELSE '' END, string_agg(concat(formatted_name, ' (', source, ')'), ' + ' ORDER BY idx)) AS said FROM grp JOIN c USING (idx) GROUP BY gr) y ON y.gr = gb""",
    "decision_state": "SELECT cluster, cluster_id, decision FROM state",
    "pending_counts": "SELECT count(*) FILTER (decision = 'pending') AS pending, count(*) FILTER (decision <> 'pending') AS resolved FROM state",
    "next_pending": "SELECT cluster, cluster_id FROM state WHERE decision = 'pending' ORDER BY score DESC, cluster_id LIMIT 1",
    "undo_entry": "SELECT cluster_id, 'undo' AS decision, round(score, 6) AS score FROM state WHERE decision <> 'pending' ORDER BY cluster DESC LIMIT 1",
    "shared_values": "SELECT a, b, CASE WHEN shared_email THEN x.email_key ELSE '' END AS emails, CASE WHEN shared_phone THEN x.phone_key ELSE '' END AS phones FROM s JOIN g x ON a = x.idx WHERE tier = 'auto_merge'",
    "resolve_from_files": """SELECT formatted_name, family_name, given_name, org, birthday, emails, phones, sources FROM mrg WHERE cluster IN (SELECT cluster FROM automem) OR (cluster IN (SELECT cluster FROM revmem) AND cluster % 3 = 0)
        UNION ALL SELECT formatted_name, family_name, given_name, org, bd, email, phone, source FROM alone UNION ALL SELECT formatted_name, family_name, given_name, org, bd, email, phone, source FROM revmem JOIN c USING (idx) WHERE cluster % 3 = 2""",
}
_RECURSIVE = ("reach", "greedy")


def _needed(sql: str) -> list[str]:
    """The steps that a text uses, directly or through others, in order."""
    import re

    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & STEPS.keys() - found:
            found.add(name)
            todo.append(STEPS[name])
    return [s for s in STEPS if s in found]


def oracle(name: str) -> str:
    final = FINAL[name]
    steps = ", ".join(f"{s} AS {'' if s in _RECURSIVE else 'MATERIALIZED '}({STEPS[s]})" for s in _needed(final))
    return f"WITH RECURSIVE {steps} {final}"


ORACLE_SQL = {name: oracle(name) for name in FINAL}
