"""Registered queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_dedup
from .line_dedup import BLOCKS, line_dedup
from .near_dedup import near_dups
from .packing import pack
from .piece_sampling import sample_pieces
from .quality_classifier import quality_scores
from .quality_rules import BOILERPLATE, CLOSERS, quality_rules
from .suffix_dedup import remove_repeats
from .toxicity import toxicity_scores
from .url_filters import url_filter

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: With a ratio of a half and hosts of two pages or more, a line on one page only never exceeds the ratio.
LINE_RATIO, LINE_PAGES = 0.5, 2


def op1_url_filters(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op2_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_minhash_near_dedup(spark, sf_dir):
    return near_dups(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(cols)


def op5_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_points")


def op7_sentencepiece_sampling(spark, sf_dir):
    return sample_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_line_dedup(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "pages"), LINE_RATIO, LINE_PAGES)
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("clean_sha256"))


def op9_toxicity(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_array_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_sentencepiece_sampling": op7_sentencepiece_sampling,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}

#: Host, path and query of a URL in DuckDB.
_URL = r"""
            CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"""
_FIT = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_RULE = "CASE " + " ".join(
    f"WHEN {_FIT.format(r.partition('/')[0], '/' + r.partition('/')[2])} THEN '{a}{r}'" for a, r in sorted(URL_RULES, key=lambda x: -len(x[1]))
) + " END"

ORACLE = {
    "op1_url_filters": r"""
        WITH RECURSIVE p0 AS (SELECT page_id, url, html, REST_URL AS rest FROM pages),
        p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query FROM p0),
        t0 AS (SELECT DISTINCT host, path, query, unnest(list_concat(
                   list_transform(regexp_extract_all(html, '(?is)<link\s[^>]*rel\s*=\s*["'']?canonical\b[^>]*>'), lambda x: regexp_extract(x, '(?is)href\s*=\s*["'']?([^"''\s>]+)', 1)),
                   list_transform(regexp_extract_all(html, '(?is)<meta\s[^>]*http-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?is)url\s*=\s*["'']?((?:&#?\w+;|[^"''\s>;])+)', 1)))) AS raw
               FROM p WHERE host <> ''),
        r0 AS (SELECT *, string_split(raw, '&#') AS ps FROM t0 WHERE raw <> ''),
        r1 AS (SELECT *, ps[1] || coalesce(array_to_string(list_transform(ps[2:], lambda x:
                      CASE WHEN coalesce(try_cast(nullif('0x' || regexp_extract(x, '^[xX]([0-9a-fA-F]{1,6});', 1), '0x') AS BIGINT), try_cast(regexp_extract(x, '^([0-9]{1,7});', 1) AS BIGINT)) BETWEEN 1 AND 127
                           THEN chr(coalesce(try_cast(nullif('0x' || regexp_extract(x, '^[xX]([0-9a-fA-F]{1,6});', 1), '0x') AS BIGINT), try_cast(regexp_extract(x, '^([0-9]{1,7});', 1) AS BIGINT))::INT) || regexp_replace(x, '^[^;]*;', '')
                           ELSE '&#' || x END), ''), '') AS named FROM r0),
        r2 AS (SELECT host, path, query, replace(replace(replace(replace(replace(named, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&') AS h FROM r1),
        t1 AS (SELECT host || path || query AS a,
                      CASE WHEN instr(h, '://') > 0 THEN h WHEN starts_with(h, '//') THEN 'http:' || h WHEN starts_with(h, '/') THEN 'http://' || host || h
                           ELSE 'http://' || host || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || h END AS target
               FROM r2),
        d0 AS (SELECT a, target, regexp_matches(target, '://[^?#]*/\.\.?(?:[/?#]|$)') AS dots, string_split(substr(regexp_extract(REST_TARGET, '^[^/?#]*([^?#]*)', 1), 2), '/') AS segments FROM t1),
        d1 AS (SELECT *, list_reduce(list_concat([''], segments), lambda x, y: CASE y WHEN '..' THEN regexp_replace(x, '/[^/]*$', '') WHEN '.' THEN x ELSE x || '/' || y END) AS way FROM d0),
        d2 AS (SELECT a, CASE WHEN dots THEN regexp_extract(target, '^[^?#]*?://[^/?#]*') || coalesce(nullif(way, ''), '/') || CASE WHEN segments[-1] IN ('.', '..') AND way <> '' THEN '/' ELSE '' END
                              || regexp_extract(target, '[?#].*$') ELSE target END AS target FROM d1),
        t2 AS (SELECT a, REST_TARGET AS rest FROM d2),
        t3 AS (SELECT a, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query FROM t2),
        e AS (SELECT a, host || path || query AS b FROM t3 WHERE host <> ''),
        n AS (SELECT host, path, host || path || query AS k FROM p WHERE host <> '' UNION SELECT host, path, host || path || query FROM t3 WHERE host <> ''),
        r AS (SELECT k, RULE AS act FROM n),
        reach(k, other) AS (SELECT a, b FROM e UNION SELECT b, a FROM e
                            UNION SELECT reach.k, x.b FROM reach JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) x ON reach.other = x.a),
        c AS (SELECT reach.k, bool_or(starts_with(act, 'block')) AS bl, bool_or(starts_with(act, 'allow')) AS al FROM reach JOIN r ON reach.other = r.k GROUP BY 1),
        j AS (SELECT p.*, RULE AS act FROM p)
        SELECT page_id, host, path, substr(act, 6) AS rule,
               coalesce(substr(act, 1, 5), CASE WHEN coalesce(bl, false) AND NOT coalesce(al, false) THEN 'block' END, 'allow') AS verdict
        FROM j LEFT JOIN c ON j.host <> '' AND c.k = j.host || j.path || j.query""".replace("REST_URL", _URL.format("url")).replace("REST_TARGET", _URL.format("target")).replace("RULE", _RULE),
    "op3_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM p),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        x AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(d, o) AS (SELECT a, b FROM x UNION SELECT r.d, x.b FROM r JOIN x ON r.o = x.a),
        c AS (SELECT d, min(o) AS o FROM r GROUP BY 1)
        SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, least(documents.doc_id, coalesce(o, documents.doc_id)) AS component_id, documents.doc_id <= coalesce(o, documents.doc_id) AS kept
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.d = documents.doc_id""",
    "op4_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        ws AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, t FROM d),
        w AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM ws),
        g AS (SELECT doc_id, i, a, lead(a) OVER v AS b, lead(a, 2) OVER v AS c FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
        r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g WHERE c IS NOT NULL),
        p AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM r WHERE k > 1),
        reps AS (SELECT doc_id, count(*) AS n_repeat_words FROM p GROUP BY 1),
        l0 AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d),
        l1 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l0),
        l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth,
                     regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words,
                     length(regexp_replace(line, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(line, '[^a-z]', '', 'g')) AS low,
                     length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars
              FROM l1 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        f AS (SELECT *, NOT regexp_matches(line, '[CLOSERS][\x20\x09-\x0D]*$')
                     OR regexp_matches(line, '(?i)(BOILERPLATE)')
                     OR up >= 10 AND 100 * up > 60 * (up + low)
                     OR len(list_filter(words, lambda x: x IN ('|', '>', '>>', '»', '·', '•', '/', '-', '–'))) >= 2
                     OR 100 * len(list_filter(words, lambda x: regexp_matches(x, '[#*$%&|<>]'))) > 30 * len(words) AS bad
              FROM l),
        ls AS (SELECT doc_id, sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END)::BIGINT AS n_dup_lines,
                      sum(CASE WHEN bad THEN chars ELSE 0 END)::BIGINT AS lost FROM f GROUP BY 1),
        o AS (SELECT ws.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                     coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
              FROM ws LEFT JOIN ls USING (doc_id) LEFT JOIN reps USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * word_chars AS kept
        FROM o""".replace("BOILERPLATE", BOILERPLATE).replace("CLOSERS", CLOSERS.replace("]", "\\]").replace("'", "''")),
    "op6_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = first_value(doc_id) OVER w AND n = first_value(n) OVER w AS kept, h AS text_sha256
        FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)""",
    "op8_line_dedup": r"""
        WITH t AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
            string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)</?(BLOCKS)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) AS raw FROM pages),
        p AS (SELECT page_id, coalesce(host, '') AS host, list_filter(list_transform(raw, lambda x: regexp_replace(x, '^[ \t\x0B-\r]+|[ \t\x0B-\r]+$', '', 'g')), lambda x: x <> '') AS lines FROM t),
        h AS (SELECT host, count(DISTINCT page_id) AS pages FROM p WHERE host <> '' GROUP BY 1),
        l AS (SELECT page_id, host, unnest(lines) AS line FROM p WHERE host <> ''),
        c AS (SELECT host, line, count(DISTINCT page_id) AS k FROM l GROUP BY ALL),
        b AS (SELECT host, list(line) AS bad FROM c JOIN h USING (host) WHERE pages >= 2 AND k > 0.5 * pages GROUP BY 1)
        SELECT page_id, host, len(lines)::BIGINT AS n_lines,
               len(list_filter(lines, lambda x: coalesce(list_contains(bad, x), false)))::BIGINT AS n_dropped,
               sha256(array_to_string(list_filter(lines, lambda x: NOT coalesce(list_contains(bad, x), false)), chr(10))) AS clean_sha256
        FROM p LEFT JOIN b USING (host)""".replace("BLOCKS", BLOCKS),
    "op10_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        b AS (SELECT doc_id, h, unnest(range(0, length(h), 800)) AS off FROM d),
        c AS (SELECT doc_id, off // 2 AS base, substr(h, off + 1, 1198) AS part FROM b),
        w AS (SELECT doc_id, base + k AS pos, md5_number(substr(part, 2 * k + 1, 400)) AS m FROM (SELECT *, unnest(range(0, least(400, length(part) // 2 - 199))) AS k FROM c WHERE length(part) >= 400)),
        g AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
        x AS (SELECT doc_id, pos, pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 200 AS far FROM w SEMI JOIN g USING (m)),
        y AS (SELECT doc_id, pos, sum(coalesce(far, TRUE)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM x),
        s AS (SELECT doc_id, span, min(pos) AS a, max(pos) + 200 AS z FROM y GROUP BY ALL),
        t AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY span), 0) AS before FROM s),
        k AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY span) || substr(any_value(h), 2 * max(z) + 1) AS left_over, sum(z - a) AS gone, count(*) AS spans FROM t JOIN d USING (doc_id) GROUP BY 1)
        SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
}
