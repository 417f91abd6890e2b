"""DuckDB SQL for the registered queries: one chain of common table expressions over the test tables."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from foliant.functions import text as T
from foliant.functions.taxonomy import ADDED, MAY_BE_ABSENT, ORDER, TITLES, label_eras
from foliant.plans.filings import filings_sql, inexact


def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


_NORM = r"trim(regexp_replace(lower({}), '[^a-z0-9 ]+', ' ', 'g'))"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_HEAD = r"(?i)^[ \t]*item[ \t]*([0-9]{1,2})([A-Da-d])?(?:[.][ \t]*(.*))?$"
_REF, _OTHER, _ITEM = T.BY_REFERENCE, T.OTHER_DOCUMENT, T.OTHER_ITEM
_POINTS = "(regexp_matches({0}, '" + _REF + "') OR regexp_matches({0}, '" + _OTHER + "') OR regexp_matches({0}, '" + _ITEM + "'))"


def _norm(s: str) -> str:
    return re.sub(r"[^a-z0-9 ]+", " ", s.lower()).strip()


def _similar() -> list[tuple]:
    """(code, normalized title, greatest similarity to the code's titles) of the titles that the made filings have."""
    rows = []
    for code, (_, titles) in TITLES.items():
        names = [_norm(t) for t in titles]
        rows += [(code, n, 1.0) for n in names]
        odd = _norm(inexact(code))
        rows += [(code, odd, round(max(SequenceMatcher(None, odd, n).ratio() for n in names), 3))] if odd not in names else []
    return sorted(set(rows))


def _sentences(flat: str) -> str:
    parts = rf"string_split(regexp_replace({flat}, '([.])\s', '\1' || chr(1), 'g'), chr(1))"
    again = r"(regexp_matches(a[-1], '(?i)\bitem\s*\d{1,2}[A-D]?\.$') OR (regexp_matches(a[-1], '(?i)\bno\.$') AND regexp_matches(b[1], '^\d')))"
    return f"list_reduce([[x] FOR x IN {parts}], lambda a, b: CASE WHEN {again} THEN a[:-2] || [a[-1] || ' ' || b[1]] ELSE a || b END)"


def _runs(rows: str, member: str) -> str:
    return f"""
SELECT *, dense AND count(DISTINCT CASE WHEN recurs THEN item END) OVER (PARTITION BY doc_id, member, run_id) * 2 >= n_codes AS contents FROM (
SELECT *, coalesce(max(CASE WHEN NOT echo THEN start END) OVER (PARTITION BY doc_id, item) > start, false) AS recurs FROM (
SELECT *, dense AND count(DISTINCT CASE WHEN before THEN item END) OVER (PARTITION BY doc_id, member, run_id) * 2 >= n_codes AS echo FROM (
SELECT *, coalesce(min(CASE WHEN NOT dense THEN start END) OVER (PARTITION BY doc_id, item) < start, false) AS before FROM (
SELECT *, member AND n_codes >= 5 AS dense FROM (
SELECT *, count(DISTINCT item) OVER (PARTITION BY doc_id, member, run_id) AS n_codes FROM (
SELECT *, sum(gap) OVER (PARTITION BY doc_id, member ORDER BY start) AS run_id FROM (
SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id, member ORDER BY start) > 400 THEN 1 ELSE 0 END AS gap FROM (
SELECT *, {member} AS member FROM {rows}))))))))"""


CTES = {
    "raw": filings_sql(),
    "dim": f"SELECT code, ord, added::DATE AS added_on FROM (VALUES {_values((c, i, ADDED.get(c)) for i, c in enumerate(ORDER))}) t(code, ord, added)",
    "eras": f"SELECT code, ord, f::DATE AS valid_from, t::DATE AS valid_to, part, title FROM (VALUES {_values(label_eras())}) x(code, ord, f, t, part, title)",
    "alias": f"SELECT code, norm, score::DOUBLE AS score FROM (VALUES {_values(_similar())}) x(code, norm, score)",
    "docs00": r"""SELECT doc_id, raw_text, contains(raw_text, '<DOCUMENT>') AS wrapped, contains(raw_text, '<TYPE>10-K' || chr(10)) AS chosen,
  nullif(upper(regexp_extract(regexp_extract(raw_text, '(?s)<DOCUMENT>.*?</DOCUMENT>'), '(?m)^<TYPE>(\S+)', 1)), '') AS first_type FROM raw""",
    "docs01": """SELECT *, CASE WHEN chosen THEN regexp_extract(raw_text, '(?s)<TEXT>(.*?)</TEXT>', 1) ELSE raw_text END AS body FROM docs00""",
    "docs02": r"""SELECT *, CASE WHEN contains(lower(body), '<ix:') THEN 'ixbrl' WHEN regexp_matches(body, '(?i)<(?:html|body|div|font|span|p)[\s>/]') THEN 'html' ELSE 'txt' END AS era FROM docs01""",
    # the fixed markup of the made filings: paragraphs of one line, a script, and an inline fact
    "docs03": r"""SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(body, '&#160;', ' '), '(?s)<(title|script|ix:header)>.*?</(title|script|ix:header)>', '', 'g'), '<[^>]*>', chr(10), 'g'), '[ \t]+', ' ', 'g') AS bare FROM docs02""",
    "docs0": f"""SELECT doc_id, raw_text, wrapped, chosen, first_type, era, {_STRIP.format("CASE WHEN era = 'txt' THEN body ELSE regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(bare, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), ' ?\n ?', chr(10), 'g'), '\n+', chr(10) || chr(10), 'g'), ' +', ' ', 'g') END")} AS text FROM docs03""",
    "docs1": r"""SELECT *, length(text) AS norm_chars, CASE WHEN chosen THEN '10-K' WHEN wrapped THEN first_type END AS declared,
  nullif(upper(regexp_extract(substr(text, 1, 3000), '(?i)\bFORM\s{0,4}(10-[A-Z0-9]{1,4})\b', 1)), '') AS sniffed,
  nullif(regexp_extract(raw_text, 'CONFORMED PERIOD OF REPORT:\s*(\d{8})', 1), '') AS header,
  nullif(regexp_replace(regexp_extract(raw_text, 'DocumentPeriodEndDate">([^<]*)<', 1), '&#160;', ' '), '') AS fact,
  nullif(regexp_extract(substr(text, 1, 6000), '(?i)fiscal year ended[:\s]*([A-Z][a-z]{2,8}\.?\s+\d{1,2}\s*,?\s*\d{4})', 1), '') AS cover FROM docs0""",
    "docs": """SELECT doc_id, raw_text, text, norm_chars, wrapped, chosen, era, declared, sniffed, coalesce(declared, sniffed) AS form_type,
  coalesce(strptime(header, '%Y%m%d')::DATE, strptime(fact, '%B %d, %Y')::DATE, strptime(cover, '%B %d, %Y')::DATE) AS period_end,
  CASE WHEN norm_chars < 2000 THEN 'failed' WHEN coalesce(coalesce(declared, sniffed) NOT IN ('10-K', '10-K405'), true) THEN 'unsupported' END AS gate FROM docs1""",
    "whole": "SELECT * FROM docs WHERE gate IS NULL",
    "lines0": "SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, norm_chars FROM whole",
    "lines": f"""SELECT doc_id, line_no, raw, {_STRIP.format("raw")} AS stripped, norm_chars,
  (coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS start FROM lines0""",
    "filled": "SELECT *, lead(stripped, 1) OVER w AS n1, lead(stripped, 2) OVER w AS n2, lead(start, 1) OVER w AS s1, lead(raw, 1) OVER w AS r1 FROM lines WHERE stripped <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)",
    "expected": "SELECT doc_id, period_end, code AS item, ord FROM docs JOIN dim ON added_on IS NULL OR period_end >= added_on",
    "heads": rf"""SELECT f.*, regexp_extract(raw, '{_HEAD}', 1) || upper(regexp_extract(raw, '{_HEAD}', 2)) AS item,
  {_STRIP.format(f"regexp_extract(raw, '{_HEAD}', 3)")} AS own FROM filled f WHERE regexp_matches(raw, '{_HEAD}')""",
    "heads1": f"""SELECT h.*, CASE WHEN own <> '' THEN own ELSE coalesce(n1, '') END AS shown FROM heads h JOIN expected e ON h.doc_id = e.doc_id AND h.item = e.item""",
    "heads2": f"""SELECT h.*, coalesce(a.score, 0) AS score, own = '' AND coalesce(a.score, 0) >= 0.37 AND NOT coalesce(regexp_matches(n2, '{_HEAD}'), false) AS via
  FROM heads1 h LEFT JOIN alias a ON a.code = h.item AND a.norm = {_NORM.format("h.shown")}""",
    "cands": """SELECT doc_id, item, start, (CASE WHEN via THEN s1 + length(r1) - length(ltrim(r1)) + length(n1) ELSE start + length(raw) END)::INTEGER AS heading_end,
  stripped AS heading_text, CASE WHEN own <> '' THEN own WHEN via THEN n1 ELSE '' END AS title,
  CASE WHEN own <> '' OR via THEN score ELSE 0.0 END::DOUBLE AS similarity, own <> '' OR via AS titled, via AS title_on_next_line, stripped = upper(stripped) AS upper FROM heads2""",
    "kept0": "SELECT * FROM cands WHERE titled AND similarity >= 0.37",
    "kept": _runs("kept0", "true"),
    "bare": _runs("cands", "NOT titled"),
    "man1": "SELECT doc_id, list(item ORDER BY start) AS m FROM kept WHERE contents GROUP BY doc_id",
    "man2": "SELECT doc_id, list(item ORDER BY start) AS m FROM bare WHERE contents GROUP BY doc_id",
    "manifest": "SELECT coalesce(man1.doc_id, man2.doc_id) AS doc_id, coalesce(man1.m, man2.m) AS manifest FROM man1 FULL JOIN man2 ON man1.doc_id = man2.doc_id",
    "surv": "SELECT * FROM kept WHERE NOT (contents AND recurs)",
    "eord": "SELECT doc_id, item, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS step FROM expected SEMI JOIN whole USING (doc_id)",
    "walk": """SELECT doc_id, 0::BIGINT AS step, NULL::VARCHAR AS item, NULL::INTEGER AS start, 0::INTEGER AS cursor, false AS hit FROM whole
  UNION ALL SELECT w.doc_id, e.step, e.item, s.start, coalesce(s.heading_end, w.cursor), s.start IS NOT NULL
  FROM walk w JOIN eord e ON e.doc_id = w.doc_id AND e.step = w.step + 1
  LEFT JOIN LATERAL (SELECT start, heading_end FROM surv c WHERE c.doc_id = w.doc_id AND c.item = e.item AND c.start >= w.cursor ORDER BY start LIMIT 1) s ON true""",
    "accepted": "SELECT w.doc_id, w.item, w.start, c.heading_end, c.heading_text, c.similarity FROM walk w JOIN surv c ON c.doc_id = w.doc_id AND c.item = w.item AND c.start = w.start WHERE hit",
    "acc1": """SELECT a.*, coalesce(lead(a.start) OVER w, norm_chars) AS bound, lead(a.start) OVER w IS NULL AS last FROM accepted a JOIN whole USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a.start)""",
    "marks": r"""SELECT doc_id, start AS mk, regexp_matches(raw, '(?i)^[ \t]*executive officers of (the )?(registrant|company)(?:[^.\w]|$)') AS officers,
  regexp_matches(raw, '(?i)^[ \t]*(SIGNATURES?|Pursuant to the requirements of Section 13)\b') AS tail FROM lines""",
    "clip": """SELECT doc_id, item, least(min(CASE WHEN officers AND item <> '10' AND mk < bound THEN mk END), min(CASE WHEN tail AND last THEN mk END)) AS clip
  FROM acc1 JOIN (SELECT * FROM marks WHERE officers OR tail) m USING (doc_id) WHERE mk >= heading_end GROUP BY doc_id, item""",
    "spans": "SELECT a.doc_id, a.item, a.start, least(bound, coalesce(clip, bound))::INTEGER AS \"end\", heading_end, heading_text, similarity FROM acc1 a LEFT JOIN clip c ON a.doc_id = c.doc_id AND a.item = c.item",
    "flat": r"""SELECT s.*, trim(regexp_replace(substr(text, heading_end + 1, greatest("end" - heading_end, 0)), '\s+', ' ', 'g')) AS flat FROM spans s JOIN whole USING (doc_id)""",
    "sents": f"SELECT *, {_sentences('flat')} AS parts FROM flat",
    "lead0": f"SELECT *, coalesce(list_position([{_POINTS.replace('{0}', 'x')} FOR x IN parts], false), len(parts) + 1) AS stop FROM sents",
    "judged": f"""SELECT *, CASE WHEN regexp_matches(flat, '{_REF}') AND regexp_matches(array_to_string(parts[:stop - 1], ' '), '{_REF}') AND regexp_matches(array_to_string(parts[:stop - 1], ' '), '{_OTHER}')
  AND coalesce(list_sum([length(x) FOR x IN parts[stop:] IF NOT {_POINTS.replace('{0}', 'x')}]), 0) <= 300 THEN 'incorporated_by_reference' ELSE 'extracted' END AS found FROM lead0""",
    "labels_": """SELECT e.doc_id, e.item, e.ord, part, title FROM expected e JOIN eras r ON e.item = r.code AND CASE WHEN period_end IS NULL THEN valid_from IS NULL
  ELSE (valid_from IS NULL OR period_end >= valid_from) AND (valid_to IS NULL OR period_end < valid_to) END""",
    "items": f"""SELECT l.*, j.start, j."end", j.heading_end, j.heading_text, j.similarity,
  coalesce(found, CASE WHEN l.item IN {MAY_BE_ABSENT} THEN 'omitted' ELSE 'missing' END) AS status
  FROM labels_ l SEMI JOIN whole USING (doc_id) LEFT JOIN judged j ON l.doc_id = j.doc_id AND l.item = j.item""",
    "body": r"""SELECT i.*, norm_chars AS n, status = 'extracted' AS out, CASE WHEN status = 'extracted' THEN substr(text, start + 1, "end" - start) END AS body,
  string_split(substr(text, start + 1, 60), chr(10))[1] AS head FROM items i JOIN whole USING (doc_id)""",
    "facts": rf"""SELECT *, CASE WHEN length(body) >= 5000 THEN length(regexp_replace(body, '[^0-9$%]', '', 'g'))::DOUBLE / length(body) END AS density,
  start IS NOT NULL AND regexp_extract(head, '{_HEAD}', 1) || upper(regexp_extract(head, '{_HEAD}', 2)) <> item AS unclean,
  length(body) >= 5000 AND CASE item WHEN '1A' THEN NOT regexp_matches(prose, '\b(risk|adversely|could)\b') WHEN '3' THEN NOT regexp_matches(prose, '\b(legal|proceedings)\b')
  WHEN '8' THEN NOT regexp_matches(prose, '\b(total|net)\b') WHEN '9A' THEN NOT regexp_matches(prose, '\b(internal control|disclosure controls)\b') ELSE false END AS strange
  FROM (SELECT *, lower(substr(body, heading_end - start + 1)) AS prose FROM body)""",
    "agg": """SELECT f.doc_id, avg((status = 'missing')::INT) AS missing, count(*) FILTER (status = 'missing') AS n_missing, count(*) AS n_items, min(CASE WHEN out THEN start END) AS first, max(CASE WHEN out THEN "end" END) AS lst,
  arg_max(item, CASE WHEN out THEN start END) AS last_item, arg_max("end" - start, CASE WHEN out THEN start END) AS last_chars, max(n) AS n,
  max(CASE WHEN item = '8' THEN density END) AS d8, max(CASE WHEN item = '1A' THEN density END) AS d1a, list(item) FILTER (start IS NOT NULL) AS acc FROM facts f GROUP BY f.doc_id""",
    "battery0": """SELECT agg.*, list_filter(manifest, lambda x: NOT coalesce(list_contains(acc, x), false)) AS unmet, (first + (n - lst)) / n AS outside, last_chars / n AS last_share FROM agg LEFT JOIN manifest USING (doc_id)""",
    "battery": """SELECT doc_id, 1 AS seq, 'toc_manifest_mismatch' AS code, NULL AS item, 'listed in the contents, but not found: ' || array_to_string(unmet, ', ') AS message FROM battery0 WHERE len(unmet) > 0
  UNION ALL SELECT doc_id, 2, 'expected_items_mostly_missing', NULL, n_missing || ' of ' || n_items || ' expected items have no heading' FROM battery0 WHERE missing > 0.25
  UNION ALL SELECT doc_id, 3, 'unattributed_content', NULL, first || ' characters before the first item, ' || (n - lst) || ' after the last' FROM battery0 WHERE outside > 0.17
  UNION ALL SELECT doc_id, 4, 'last_item_dominates', last_item, 'item ' || last_item || ' takes ' || round_even(last_share * 100, 0)::INT || '% of the document' FROM battery0 WHERE last_share > 0.5
  UNION ALL SELECT doc_id, 600, 'numeric_density_inversion', '8', 'item 8 has no more figures than item 1A' FROM battery0 WHERE d8 <= d1a
  UNION ALL SELECT doc_id, 100 + ord, 'boundary_hygiene', item, 'item ' || item || ' does not begin with its heading' FROM facts WHERE unclean
  UNION ALL SELECT doc_id, 700 + ord, 'keyword_fingerprint', item, 'item ' || item || ' has none of its words' FROM facts WHERE strange""",
    "ambig": "SELECT i.doc_id, NOT bool_or(status = 'extracted') OR i.doc_id IN (SELECT doc_id FROM battery WHERE code IN ('toc_manifest_mismatch', 'last_item_dominates', 'expected_items_mostly_missing')) AS ambiguous FROM items i GROUP BY i.doc_id",
    "hits": "SELECT doc_id, item, count(*) AS h FROM battery WHERE item IS NOT NULL GROUP BY doc_id, item",
    "scored": """SELECT i.*, ambiguous, CASE WHEN start IS NULL THEN 'status_keyword' WHEN similarity >= 0.8 THEN 'heading_strict' ELSE 'heading_lenient' END AS method,
  CAST(least(CASE WHEN ambiguous THEN 0.75 ELSE 0.95 END, CASE status WHEN 'extracted' THEN CASE WHEN similarity >= 0.8 THEN 0.95 ELSE 0.75 END
  WHEN 'incorporated_by_reference' THEN 0.85 WHEN 'omitted' THEN 0.80 ELSE 0.40 END - 0.15 * coalesce(h, 0)) AS DOUBLE) AS confidence
  FROM items i JOIN ambig USING (doc_id) LEFT JOIN hits ON i.doc_id = hits.doc_id AND i.item = hits.item""",
    "warned": """SELECT doc_id, code, item, message FROM battery UNION ALL SELECT doc_id, 'expected_item_missing', item, 'no heading of item ' || item FROM items WHERE status = 'missing'
  UNION ALL SELECT doc_id, 'period_end_unknown', NULL, 'no period of report: the expected items are a guess' FROM whole WHERE period_end IS NULL
  UNION ALL SELECT doc_id, CASE gate WHEN 'failed' THEN 'normalization_collapse' ELSE 'unsupported_form' END, NULL,
    CASE gate WHEN 'failed' THEN length(raw_text) || ' raw characters left ' || norm_chars ELSE 'form ' || coalesce(form_type, 'none') || ' is not segmented' END FROM docs WHERE gate IS NOT NULL
  UNION ALL SELECT doc_id, 'whole_submission_fallback', NULL, 'no block declares an annual report (' || CASE WHEN declared IS NULL THEN '<none>, EX-13' ELSE 'EX-13, ' || declared END
    || '): the whole submission is read, exhibits too' FROM docs WHERE wrapped AND NOT chosen
  UNION ALL SELECT doc_id, 'form_type_disagreement', NULL, 'the header says ' || declared || ', the cover ' || sniffed FROM docs
    WHERE declared IS NOT NULL AND sniffed IS NOT NULL AND replace(declared, '-', '') <> replace(sniffed, '-', '') AND NOT (declared IN ('10-K', '10-K405') AND sniffed IN ('10-K', '10-K405'))""",
    "states": """SELECT d.doc_id, coalesce(gate, CASE WHEN ambiguous THEN 'ambiguous' WHEN d.doc_id IN (SELECT doc_id FROM warned) THEN 'success_with_warning' ELSE 'success' END) AS doc_status
  FROM docs d LEFT JOIN ambig ON d.doc_id = ambig.doc_id""",
    "alllines0": "SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, norm_chars FROM docs",
    "alllines": f"""SELECT doc_id, line_no, raw, {_STRIP.format("raw")} AS stripped, norm_chars,
  (coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS start FROM alllines0""",
    "gaps": "SELECT *, start - lag(start) OVER (PARTITION BY doc_id, stripped ORDER BY line_no) AS gap FROM alllines",
    "heads_": "SELECT doc_id, stripped FROM gaps WHERE stripped <> '' GROUP BY doc_id, stripped HAVING count(*) >= 8 AND avg(gap) > 0 AND stddev_pop(gap) / avg(gap) <= 0.6 AND (max(start) - min(start)) / max(norm_chars) >= 0.7",
    "sure": r"""SELECT a.*, CASE WHEN a.stripped <> '' AND regexp_full_match(a.stripped, '(?i)(?:</?(?:PAGE|TABLE|CAPTION|S|C|FN)>\s*)+') THEN 'edgar_chrome' WHEN h.stripped IS NOT NULL THEN 'running_head' END AS sure
  FROM alllines a LEFT JOIN heads_ h ON a.doc_id = h.doc_id AND a.stripped = h.stripped""",
    "num": r"SELECT *, sure IS NULL AND regexp_full_match(stripped, '(?i)(?:page\s+)?[-–—\s]*\d{1,3}[-–—.\s]*') AS number FROM sure WHERE stripped <> ''",
    "isl": "SELECT *, sum(CASE WHEN number THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island, lag(sure IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY line_no) AS above, lead(sure IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY line_no) AS below FROM num",
    "chrome": """SELECT doc_id, line_no, start, least(start + length(raw) + 1, norm_chars)::INTEGER AS "end", kind FROM (
  SELECT *, CASE WHEN sure IS NOT NULL THEN sure WHEN number AND (coalesce(first_value(above) OVER (PARTITION BY doc_id, number, island ORDER BY line_no), false) OR coalesce(below, false)) THEN 'page_number' END AS kind FROM isl) WHERE kind IS NOT NULL""",
}
_WITH = "WITH RECURSIVE " + ",\n".join(f"{name} AS ({sql})" for name, sql in CTES.items())


def chain(select: str) -> str:
    return f"{_WITH}\n{select}"
