"""Registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import prepare, read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return add


@query("op1_contextual_pii")
def contextual_pii(spark, sf_dir):
    from .pii import find_personal_data

    return find_personal_data(read_table(spark, sf_dir, "documents"))


@query("op2_minhash_near_dedup", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(b) AS component_id, w.doc_id = min(b) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id, n.n
""")
def minhash_near_dedup(spark, sf_dir):
    from .minhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, percent=85).drop("text_hash")


@query("op3_licence_scan")
def licence_scan(spark, sf_dir):
    from .licences import all_templates, scan_licences

    return scan_licences(read_table(spark, sf_dir, "documents"), all_templates())


@query("op4_quality_classifier")
def quality_classifier(spark, sf_dir):
    from .quality import classify

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op5_html_extraction")
def html_extraction(spark, sf_dir):
    from .html import extract

    return extract(read_table(spark, sf_dir, "pages"))


@query("op6_warc_index", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d FROM p),
f AS (SELECT d, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, q.d AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q LEFT JOIN f ON q.d = f.d AND n >= 100
""")
def warc_index(spark, sf_dir):
    from .warc import archive

    return archive(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_line_frequency", r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, t FROM d),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
raw AS (SELECT doc_id, host, {'d': doc_id, 't': hash(t)} AS th, unnest(string_split(t, chr(10))) AS l FROM d),
lines AS (SELECT * FROM (SELECT *, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw FROM raw) WHERE len(lw) > 0),
dups AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, l, count(*) AS c FROM lines GROUP BY doc_id, l) GROUP BY doc_id),
norm AS (SELECT doc_id, host, th, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS nl, len(lw) AS c FROM lines),
sizes AS (SELECT host, least(count(DISTINCT {'d': doc_id, 't': hash(t)}), 10000) AS a FROM d GROUP BY host),
boiler AS (SELECT host, nl FROM (SELECT host, nl, count(DISTINCT th) AS n FROM norm GROUP BY host, nl) JOIN sizes USING (host) WHERE n > 20 AND n > a * 0.01),
gone AS (SELECT doc_id, sum(c) AS n FROM norm SEMI JOIN boiler USING (host, nl) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS boilerplate_words
      FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND boilerplate_words < 0.8 * n_words AS kept
FROM f
""")
def line_frequency(spark, sf_dir):
    from .lines import judge

    return judge(read_table(spark, sf_dir, "documents"))


@query("op8_substring_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""")
def substring_dedup(spark, sf_dir):
    from .superkmer import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"), with_text=False)


@query("op9_benchmark_decontamination")
def benchmark_decontamination(spark, sf_dir):
    from .decontam import PASSAGE, find_leaks

    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), passage=PASSAGE)


@query("op10_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    from .packing import pack_documents
    from .stages import default_tokenizer

    return pack_documents(read_table(spark, sf_dir, "documents"), default_tokenizer())


@query("op11_phrase_collocations", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
spots AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (SELECT lang, phrase, k, count(*) AS n FROM (SELECT lang, k, array_to_string(ws[i:i+k-1], ' ') AS phrase FROM spots JOIN (VALUES (1), (2), (3), (4)) AS t(k) ON i + k - 1 <= len(ws))
      GROUP BY lang, phrase, k HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT c.*, j, l.n AS l, r.n AS r, (2000000::HUGEINT * a) // (l.n + r.n) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
         JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[j+1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(ws[s:s+m-1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, ws, k, a, m, unnest(range(1, k - m + 2)) AS s FROM c JOIN (VALUES (2), (3)) AS t(m) ON m < k) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total.n, score::BIGINT AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
""")
def phrase_collocations(spark, sf_dir):
    from .phrases import mine_phrases

    return mine_phrases(read_table(spark, sf_dir, "documents"))


@query("op12_tokenizer_alignment")
def tokenizer_alignment(spark, sf_dir):
    import public_tokenizers

    from .tokenmap import align_tokenizers

    return align_tokenizers(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_url_filter", r"""
WITH u AS (SELECT page_id, url, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                  CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT *, translate(regexp_extract(coalesce(rest, ''), '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '\A[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(v, h, s) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
places AS (SELECT page_id, url, max({'n': length(h || s), 'r': h || s, 'v': v}) AS r
           FROM (SELECT DISTINCT page_id, url, host, path FROM p) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id, url),
labels(v, w) AS (SELECT 'block', unnest(['adult', 'betting', 'bingo', 'casino', 'casinos', 'escort', 'escorts', 'gambling', 'jackpot', 'poker', 'porn', 'porno', 'roulette', 'sex', 'slots',
    'viagra', 'cialis', 'xxx', 'buy-followers', 'cheap-meds', 'cheap-pills', 'cheap-viagra', 'essay-writing', 'free-casino', 'free-porn', 'link-farm', 'online-casino', 'payday-loan',
    'payday-loans', 'replica-watches', 'spam-farm']) UNION ALL SELECT 'allow', unnest(['sex-education', 'responsible-gambling'])),
patterns AS (SELECT v, '||' || w || '^' AS p, '(?s)\A[^:/?#]*://(?:[^/?#]*\.)?' || w || '(?:[^a-z0-9%]|\z)' AS x FROM labels
    UNION ALL SELECT 'block', '||' || w || '.', '(?s)\A[^:/?#]*://(?:[^/?#]*\.)?' || w || '\.' FROM (SELECT unnest(['ads', 'adserver', 'tracker', 'tracking', 'doubleclick']) AS w)
    UNION ALL SELECT 'block', '/' || w || '^', '(?s)/' || replace(w, '.', '\.') || '(?:[^a-z0-9%]|\z)' FROM (SELECT unnest(['wp-login.php', 'cgi-bin', 'checkout', 'add-to-cart', 'unsubscribe']) AS w)
    UNION ALL SELECT 'block', '.' || w || '|', '(?s)\.' || w || '\z' FROM (SELECT unnest(['exe', 'zip', 'iso', 'apk', 'dmg', 'css', 'js']) AS w)
    UNION ALL SELECT 'block', '/[?&](?:sessionid|phpsessid|jsessionid)=[0-9a-z]{16,}/', '(?s)[?&](?:sessionid|phpsessid|jsessionid)=[0-9a-z]{16,}'),
fits AS (SELECT url, min({'v': v, 'p': p}) AS f FROM (SELECT DISTINCT url, low FROM p) JOIN patterns ON regexp_matches(low, x) GROUP BY url)
SELECT p.page_id, host, path, r.r AS rule, coalesce(r.v, f.v, 'allow') AS verdict, CASE WHEN r IS NULL THEN f.p END AS pattern
FROM p LEFT JOIN places ON p.page_id IS NOT DISTINCT FROM places.page_id AND p.url = places.url LEFT JOIN fits ON p.url = fits.url
""")
def url_filter(spark, sf_dir):
    from .urls import judge_urls, pattern_table, rule_table

    return judge_urls(read_table(spark, sf_dir, "pages"), rule_table(spark), pattern_table(spark))
