"""DuckDB SQL of the queries that SQL can express."""

# The licence lines that are planted in the documents, and what they say; written apart from the operator's templates.
_PLANTED = [(line.format(name=name), licence) for name, licence in (
    ("the MIT License", "MIT"), ("the Apache License, Version 2.0", "Apache-2.0"), ("the GNU General Public License, version 2", "GPL-2.0"),
    ("the GNU General Public License, version 3", "GPL-3.0"), ("CC BY 4.0", "CC-BY-4.0"), ("CC BY-SA 4.0", "CC-BY-SA-4.0"), ("CC BY-NC 4.0", "CC-BY-NC-4.0"),
) for line in ("Licensed under {name}.", "Released under {name}.", "This work is licensed under {name}.") if not (name[:2] == "CC" and line[0] != "L")]
# a bare reservation of rights only counts where nothing names a licence
_PLANTED_ROWS = ", ".join([f"('{line}', '{licence}', 2)" for line, licence in _PLANTED] + ["('All rights reserved.', 'all-rights-reserved', 0)"])

ORACLES = {
    "op2_progressive_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op6_license_scan": f"""
        WITH planted(line, licence, rank) AS (VALUES {_PLANTED_ROWS}),
             f AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, concat_ws('/', source, lang, floor(doc_id / 1000.0)::BIGINT) AS thousand FROM documents),
             own AS (SELECT doc_id, max({{'r': rank, 'l': licence}}) AS said FROM (SELECT doc_id, trim(unnest(lines)) AS line FROM f) JOIN planted USING (line) GROUP BY doc_id),
             g AS (SELECT doc_id, thousand, trim(lines[-1]) IN (SELECT line FROM planted) AS closes FROM f),
             p AS (SELECT doc_id, closes, CASE WHEN closes THEN thousand ELSE thousand || '/' || floor(doc_id / 100.0)::BIGINT END AS dir,
                          CASE WHEN closes THEN 'LICENSE-' || doc_id ELSE doc_id::VARCHAR END AS name FROM g),
             dirs AS (SELECT dir AS from_dir, max(said).l AS licence FROM p JOIN own USING (doc_id) WHERE closes GROUP BY dir),
             near AS (SELECT dir, arg_max({{'d': from_dir, 'l': licence}}, length(from_dir)) AS n
                      FROM (SELECT DISTINCT dir FROM p) JOIN dirs ON from_dir = dir OR starts_with(dir, from_dir || '/') GROUP BY dir)
        SELECT p.doc_id, p.dir || '/' || p.name AS path, coalesce(own.said.l, n.l) AS license,
               CASE WHEN coalesce(own.said.l, n.l) IS NOT NULL THEN 1.0::DOUBLE END AS license_cosine,
               CASE WHEN own.said IS NOT NULL THEN 'own' WHEN n.l IS NOT NULL THEN 'inherited' ELSE 'none' END AS license_via,
               CASE WHEN own.said IS NULL THEN n.d END AS license_dir
        FROM p LEFT JOIN own USING (doc_id) LEFT JOIN near USING (dir)""",
    "op10_poisson_mix": """
        WITH s AS (SELECT source, count(*)::DOUBLE AS n,
                          CASE source WHEN 'src0' THEN 0.5 WHEN 'src1' THEN 2.0 WHEN 'src2' THEN 2.0 ELSE 1.0 END::DOUBLE AS w
                   FROM documents GROUP BY source),
             r AS (SELECT source, (SELECT sum(n) FROM s) * w / ((SELECT sum(w) FROM s) * n) AS rate FROM s),
             p AS (SELECT source, rate, k, exp(-rate) * pow(rate, k) / gamma(k + 1) AS pk
                   FROM r, range(0, 120) AS t(k)),
             c AS (SELECT source, k, sum(pk) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
             d AS (SELECT doc_id, source, rate, md5(coalesce(text, '')) AS text_md5,
                          (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':7'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
                   FROM documents JOIN r USING (source)),
             n AS (SELECT doc_id, source, rate, text_md5, (SELECT count(*) FROM c WHERE c.source = d.source AND c.cdf < d.u) AS copies FROM d),
             e AS (SELECT doc_id, source, rate, text_md5, copies, unnest(range(1, copies + 1)) AS copy_no FROM n)
        SELECT doc_id, source, copy_no, copies, round(rate, 9) AS mix_rate,
               (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || copy_no || ':8'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS mix_key, text_md5
        FROM e""",
    "op11_url_filter": """
        WITH r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                     ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
             u AS (SELECT page_id, row_number() OVER () AS k,
                          CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
             s AS (SELECT page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(rest[length(regexp_extract(rest, '^[^/?#]*')) + 1:], '^[^?#]*') AS path FROM u),
             f AS (SELECT k, arg_max({'r': rh || rp, 'v': v}, length(rh || rp)) AS best FROM s
                   JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k)
        SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM s LEFT JOIN f USING (k)""",
    "op13_source_audit": r"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
                                         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents),
             o AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
             keep AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
             g AS (SELECT DISTINCT lang, source FROM d),
             c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN keep USING (lang, term) GROUP BY ALL),
             cells AS (SELECT g.lang, g.source, keep.term, coalesce(c.n, 0) AS n, keep.n AS in_lang
                       FROM g JOIN keep USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = keep.term),
             p AS (SELECT lang, source, term, n,
                          1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p,
                          1 + 1000000000::HUGEINT * (in_lang + 5) // (sum(in_lang) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS q
                   FROM cells),
             pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(v.value, 0)::BIGINT AS value
                       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                       LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y
                                  ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) v
                       ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
             both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
                            UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM both_parts)
        WHERE part = 'pair' OR rank <= 50""",
}
