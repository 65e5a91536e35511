"""DuckDB SQL for the queries in evaluation.py and for pareto_log_spaced. Without SQL: probe_report (probes fitted until they stand still) and
baseline_run (passes over shuffled batches); tests compare them with plain numpy."""

from __future__ import annotations

from glimmer.plans.oracle import NEAR, TIES, on_base, recon

#: Max- and sum-pooled features of all examples, zeros included, and the examples' labels.
POOLED = """, pooled AS (SELECT example_idx, feature, greatest(max(greatest(h, 0)), 0) AS mx, sum(greatest(h, 0)) AS sm FROM h GROUP BY example_idx, feature
), votes AS (SELECT example_idx, label, count(*) AS n FROM act GROUP BY 1, 2
), ex AS (SELECT example_idx, arg_min(label, (-n, label)) AS label FROM votes GROUP BY example_idx
), exn AS (SELECT class, count(label) AS total FROM classes LEFT JOIN ex ON label = class GROUP BY class
), exs AS (SELECT count(*) AS n FROM ex
)"""

#: The class that each of the eight centres says.
SAYS = """, cv AS (SELECT center, label, count(*) AS n FROM near JOIN act USING (row) GROUP BY 1, 2
), cs AS (SELECT center, arg_min(label, (-n, label)) AS pred FROM cv GROUP BY center
), guess AS (SELECT pred, label FROM near JOIN act USING (row) JOIN cs USING (center)
)"""

LAYOUT = "SELECT vec_id FROM embeddings WHERE vec_id < (SELECT count(*) // 4 * 4 FROM embeddings)"


def oracle_sql() -> dict[str, str]:
    b = on_base
    evaluated = "SELECT sum(nnz)::DOUBLE / (SELECT n FROM total) AS l0, sum(sum) / (SELECT n FROM total) AS l1, count_if(sparsity = 0) AS n_dead, count_if(sparsity < 1e-7) AS n_almost_dead, count_if(sparsity > 1e-2) AS n_dense FROM stats"
    auroc = ", u AS (SELECT feature, class, sum(pos * (below + (n + 1) / 2.0)) AS r, sum(pos) AS p, sum(n - pos) AS m FROM placed GROUP BY feature, class), a AS (SELECT feature, class, round(CASE WHEN p > 0 AND m > 0 THEN (r - p * (p + 1) / 2.0) / (p * m) END, 9) AS auroc FROM u)"
    return {
        "inference_summary": b(
            recon("32") + f", q AS (SELECT d, count(*) AS n, sum(x) AS s, sum(x * x) AS q, sum((x - y) * (x - y)) AS e FROM hat GROUP BY d), m AS (SELECT max(n) AS n_tokens, count(*) AS d_model, sum(e) AS e, sum(q) - sum(s * s / n) AS b FROM q), ev AS ({evaluated})",
            "SELECT n_tokens, round(e / b, 6) AS nmse, round(e / (n_tokens * d_model), 6) AS mse_per_dim, round(l0, 6) AS l0, round(l1, 6) AS l1, n_dead::BIGINT AS n_dead, n_almost_dead::BIGINT AS n_almost_dead, n_dense::BIGINT AS n_dense FROM m, ev",
        ),
        "validation_summary": b(
            recon("32") + ", held AS (SELECT row FROM act WHERE example_idx % 5 = 0)",
            """SELECT (SELECT round(1 - var_samp(x - y) / var_samp(x), 6) FROM hat WHERE row IN (SELECT row FROM held)) AS explained,
            (SELECT round(count(*)::DOUBLE / (SELECT count(*) FROM held), 6) FROM codes WHERE row IN (SELECT row FROM held)) AS l0, (SELECT round(sum(value) / (SELECT count(*) FROM held), 6) FROM codes WHERE row IN (SELECT row FROM held)) AS l1""",
        ),
        "feature_gallery": b(
            ", t AS (SELECT feature, row // 4 AS e, row_number() OVER (PARTITION BY feature ORDER BY value DESC, row) AS k FROM codes QUALIFY k <= 8), f AS (SELECT feature, e, min(k) AS k FROM t GROUP BY 1, 2), l AS (SELECT feature, string_agg(e::VARCHAR, ',' ORDER BY k) AS examples FROM f GROUP BY feature)",
            "SELECT feature, round(CASE WHEN sparsity > 0 THEN log10(sparsity) END, 6) AS log10_freq, round(CASE WHEN mean_value > 0 THEN log10(mean_value) END, 6) AS log10_value, coalesce(examples, '') AS examples FROM stats LEFT JOIN l USING (feature)",
        ),
        "task_maxima": b(TIES + auroc + ", m AS (SELECT feature, max(round(auroc, 6)) AS auroc FROM a GROUP BY feature)", "SELECT feature, auroc, row_number() OVER (ORDER BY auroc DESC, feature)::INTEGER AS place FROM m"),
        "proposal_audit": b(
            TIES + ", taken AS (SELECT feature FROM (SELECT feature FROM stats ORDER BY nnz DESC, feature LIMIT 10) UNION SELECT feature FROM (SELECT feature FROM stats ORDER BY sum DESC, feature LIMIT 10))",
            "SELECT feature, class, round(round(ap, 9), 6) AS ap FROM tap WHERE feature IN (SELECT feature FROM taken) QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(tap.ap, 9) DESC, class) = 1",
        ),
        "auc_of_yield": b(
            TIES + ", m AS (SELECT feature, max(ap) AS ap FROM tap GROUP BY feature), o AS (SELECT feature, row_number() OVER (ORDER BY nnz DESC, feature) AS position FROM stats), bu AS (SELECT unnest([3, 10, 30, 100])::INTEGER AS budget), y AS (SELECT budget, count_if(position <= budget AND ap >= 0.2) / budget::DOUBLE AS y FROM o JOIN m USING (feature) CROSS JOIN bu GROUP BY budget)",
            "SELECT round(avg(y), 6) AS auc_b FROM y",
        ),
        "best_model_per_class": b(TIES + ", m AS (SELECT feature, round(avg(ap) FILTER (total > 0), 9) AS macro_ap FROM tap GROUP BY feature)", "SELECT feature, round(macro_ap, 6) AS macro_ap FROM m QUALIFY row_number() OVER (ORDER BY m.macro_ap DESC, feature) = 1"),
        "mimic_scores": b(
            POOLED + """, rk AS (SELECT feature, example_idx, mx, rank() OVER (PARTITION BY feature ORDER BY mx) + (count(*) OVER (PARTITION BY feature, mx) - 1) / 2.0 AS k FROM pooled),
            s AS (SELECT feature, ex.label AS class, sum(k) AS r, count(*) AS p, count_if(mx > 0) / count(*)::DOUBLE AS support, avg(mx) AS mean_act FROM rk JOIN ex USING (example_idx) GROUP BY 1, 2)""",
            "SELECT feature, class, round((r - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS auroc, round(support, 6) AS support, round(mean_act, 6) AS mean_act FROM s, exs WHERE n > p",
        ),
        "task_f1_sum_pooled": b(
            POOLED + ", ta AS (SELECT unnest([0.0, 0.5])::DOUBLE AS tau), c AS (SELECT feature, class, tau, count_if(sm > tau AND label = class) AS tp, count_if(sm > tau) AS pred, count_if(label = class) AS pos FROM pooled JOIN ex USING (example_idx) CROSS JOIN classes CROSS JOIN ta GROUP BY 1, 2, 3)",
            "SELECT feature, class, round(tau, 6) AS tau, round(CASE WHEN tp > 0 THEN 2 * tp / (pred + pos)::DOUBLE ELSE 0 END, 6) AS f1 FROM c",
        ),
        "first_label_f1": b(
            POOLED + ", fl AS (SELECT example_idx, arg_min(label, label) AS label, arg_min(n, label) AS n FROM votes WHERE label <> 0 GROUP BY example_idx), ok AS (SELECT example_idx, label FROM fl WHERE n > 1), c AS (SELECT feature, class, count_if(mx > 0 AND label = class) AS tp, count_if(mx > 0 AND label <> class) AS fp, count_if(mx <= 0 AND label = class) AS fn FROM pooled JOIN ok USING (example_idx) CROSS JOIN classes GROUP BY 1, 2)",
            "SELECT feature, class, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1 FROM c",
        ),
        "classifier_summary": b(
            TIES + auroc + """, pl AS (SELECT feature, class, row_number() OVER (PARTITION BY class ORDER BY auroc DESC NULLS LAST, feature) AS place FROM a QUALIFY place <= 8),
            fi AS (SELECT c.row, c.label, pl.class, min(place) AS place FROM codes c JOIN pl USING (feature) WHERE value > 0.1 GROUP BY 1, 2, 3), ks AS (SELECT unnest([1, 2, 4, 8])::INTEGER AS k),
            sa AS (SELECT class, k, count_if(label = class) AS tp, count_if(label <> class) AS fp FROM fi CROSS JOIN ks WHERE place <= k GROUP BY 1, 2),
            ba AS (SELECT class, k, round((coalesce(tp, 0) / total::DOUBLE + 1 - coalesce(fp, 0) / (n - total)::DOUBLE) / 2, 9) AS acc FROM npos CROSS JOIN ks CROSS JOIN total LEFT JOIN sa USING (class, k) WHERE total > 0 AND total < n),
            be AS (SELECT class, max(acc) AS best FROM ba GROUP BY class), fe AS (SELECT class, min(k) AS few, max(best) AS best FROM ba JOIN be USING (class) WHERE acc >= 0.9 * best GROUP BY class)""",
            "SELECT class, round(best, 6) AS best, few, pl.feature AS single FROM fe JOIN pl USING (class) WHERE place = 1",
        ),
        "probe_inputs": """SELECT f.file, count(*) AS n_vectors, (max(CASE WHEN NOT lack THEN label END) + 1)::BIGINT AS n_classes, count_if(NOT lack)::BIGINT AS n_labels, count_if(test)::BIGINT AS n_test, count_if(NOT test)::BIGINT AS n_train, count_if(lack) = 0 AS equal
            FROM (SELECT f.file, label, vec_id // 4 % 5 = 0 AS test, f.file = 'torn' AND vec_id % 50 = 7 AS lack FROM embeddings CROSS JOIN (VALUES ('whole'), ('torn')) f(file)) f GROUP BY f.file""",
        "purity_at_budgets": b(
            ", t AS (SELECT feature, label, row_number() OVER (PARTITION BY feature ORDER BY value DESC, row) AS rank FROM codes), ks AS (SELECT unnest([16, 64, 256])::INTEGER AS k), c AS (SELECT feature, k, label, count(*) AS n FROM t CROSS JOIN ks WHERE rank <= k GROUP BY 1, 2, 3)",
            "SELECT feature, k, round(max(n) / k::DOUBLE, 6) AS purity FROM c GROUP BY feature, k",
        ),
        "edit_report": b(
            NEAR + """, f AS (SELECT row, greatest(h, 0) AS f FROM h WHERE feature = 3), mv AS (SELECT dims.row, list(v + (0.5 - f) * c / s ORDER BY dims.d) AS x FROM dims JOIN f USING (row) JOIN proto ON proto.d = dims.d AND proto.feature = 3 JOIN size ON size.feature = 3 GROUP BY dims.row),
            d2 AS (SELECT row, feature AS center, list_distance(x, wv) AS d FROM mv CROSS JOIN w WHERE feature < 8), n2 AS (SELECT row, arg_min(center, (round(d, 12), center)) AS center FROM d2 GROUP BY row),
            ch AS (SELECT near.center, avg((near.center <> n2.center)::INTEGER) AS s FROM near JOIN n2 USING (row) GROUP BY near.center)""",
            "SELECT round(max(s) FILTER (center = 3), 6) AS target_changed, round(avg(s) FILTER (center <> 3), 6) AS other_changed FROM ch",
        ),
        "centre_accuracy": b(
            NEAR + SAYS + ", pc AS (SELECT label, count(*) AS n, count_if(pred = label) AS r FROM guess GROUP BY label)",
            "SELECT 'centres' AS model, round(sum(r) / sum(n)::DOUBLE, 6) AS accuracy, round(avg(r / n::DOUBLE), 6) AS balanced, round(max(n) / sum(n)::DOUBLE, 6) AS majority FROM pc",
        ),
        "centre_iou": b(
            NEAR + SAYS + ", io AS (SELECT class, count_if(pred = class AND label = class) AS i, count_if(pred = class OR label = class) AS u FROM guess CROSS JOIN classes GROUP BY class)",
            "SELECT 'centres' AS model, round(avg(i / u::DOUBLE) FILTER (u > 0), 6) AS mean_iou, (SELECT round(avg((pred = label)::INTEGER), 6) FROM guess) AS pixel_accuracy FROM io",
        ),
        "pure_patch_summary": """WITH c AS (SELECT vec_id // 4 AS e, label % 3 AS l, count(*) AS n FROM embeddings GROUP BY 1, 2), s AS (SELECT e, arg_min(l, (-n, l)) AS l, max(n) / sum(n)::DOUBLE AS s FROM c GROUP BY e),
            k AS (SELECT class, count(e) AS n FROM (SELECT unnest([0, 1, 2]) AS class) LEFT JOIN s ON l = class AND s >= 0.75 GROUP BY class) SELECT round(avg(n), 6) AS mean_n, max(n) AS max_n, min(n) AS min_n FROM k""",
        "scaled_mse": b(recon("32"), "SELECT round(avg((x - y) * (x - y)), 6) AS mse FROM hat"),
        "prefix_draws": """WITH g AS (SELECT d.draw, p.prefix, md5(d.draw || ':' || p.prefix) AS h FROM (SELECT s_suppkey AS draw FROM supplier) d, (SELECT unnest(range(1, 32))::INTEGER AS prefix) p),
            k AS (SELECT draw, prefix, round(-ln((('0x' || substr(h, 1, 8))::BIGINT::DOUBLE + 1) / 4294967297.0) / pow(prefix, -1.5), 9) AS key FROM g)
            SELECT draw, prefix FROM k QUALIFY row_number() OVER (PARTITION BY draw ORDER BY key, prefix) <= 3 UNION ALL SELECT s_suppkey, 32 FROM supplier""",
        "scan_counts": f"""WITH n AS (SELECT count(*) * 2 AS n FROM ({LAYOUT})) SELECT kind, CASE WHEN kind = 'special' THEN 0 ELSE n END AS expected, CASE WHEN kind = 'special' THEN 0 ELSE n END AS counted FROM n, (SELECT unnest(['content', 'special', 'all']) AS kind)""",
        "layer_token_scan": "SELECT label, count(*) AS n, max(vec_id // 4) AS last FROM embeddings GROUP BY label",
        "labelled_scan": "SELECT vec_id AS row, CASE WHEN vec_id % 3 <> 0 THEN label ELSE -1 END AS token_label FROM embeddings",
        "store_roundtrip": f"SELECT vec_id // 4 // 50 AS shard_idx, count(DISTINCT vec_id // 4) AS n_examples, true AS as_said FROM ({LAYOUT}) GROUP BY 1",
        "codes_roundtrip": b("", "SELECT feature, count(*) AS nnz, round(sum(value), 6) AS sum FROM codes GROUP BY feature"),
        "csv_roundtrip": "SELECT n_nationkey::INTEGER AS n_nationkey, n_name, CASE WHEN n_nationkey % 4 <> 0 THEN 'x' END AS mark FROM nation",
        "file_checks": """SELECT status, count(*) AS n, coalesce(sum(CASE WHEN status IN ('ok', 'wrong size', 'wrong digest') THEN strlen(n_name) ELSE 0 END), 0)::BIGINT AS bytes
            FROM (SELECT n_name, CASE n_nationkey % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'missing' WHEN 2 THEN 'empty' WHEN 3 THEN 'wrong size' WHEN 4 THEN 'wrong digest' ELSE 'not a file' END AS status FROM nation) GROUP BY status""",
        "manifest_roundtrip": "SELECT s_name || '.txt' AS name, 'ok' AS status, strlen(s_name || chr(10) || s_nationkey)::BIGINT AS bytes, sha256(s_name || chr(10) || s_nationkey) AS sha256 FROM supplier",
        "resumed_work": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 4)",
        "conditional_labels": "SELECT l AS lang, count(doc_id) > 0 AS made, count(doc_id) AS n FROM (SELECT unnest(['de', 'en', 'xx']) AS l) LEFT JOIN (SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) ON lang = l GROUP BY l",
        "checkpoint_roundtrip": "SELECT unnest(range(0, 32))::INTEGER AS feature, 'tied' AS kind, 1.0 AS size",
        "artifact_set": b(
            ", f AS (SELECT * FROM (VALUES ('codes', (SELECT count(*) FROM codes)), ('features', 32), ('top', 128), ('metrics', 1), ('labels', (SELECT n FROM total))) AS t(name, n))",
            "SELECT name, true AS first, false AS second, name = 'metrics' AS metrics_only, n::BIGINT AS n FROM f",
        ),
        "codes_transform": b(", m AS (SELECT row, avg(h) AS m FROM h GROUP BY row)", "SELECT feature, count(*) AS n, round(sum(h), 6) AS sum FROM h JOIN m USING (row) WHERE h > m + 0.05 GROUP BY feature"),
        "pareto_log_spaced": """WITH p AS (SELECT *, min(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM part),
            f AS (SELECT p_brand, p_partkey, p_size, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice) AS j, count(*) OVER (PARTITION BY p_brand) AS n, ln(1 + p_size) AS pos FROM p WHERE best IS NULL OR p_retailprice < best),
            e AS (SELECT p_brand, min(pos) + (max(pos) - min(pos)) / 2 AS mid FROM f GROUP BY p_brand), c AS (SELECT p_brand, arg_min(j, (round(abs(pos - mid), 12), j)) AS j FROM f JOIN e USING (p_brand) WHERE j > 1 AND j < n GROUP BY p_brand)
            SELECT f.p_brand, p_partkey, p_size, round(p_retailprice, 6) AS p_retailprice FROM f LEFT JOIN c USING (p_brand) WHERE n <= 3 OR f.j = 1 OR f.j = n OR f.j = c.j""",
        "stem_join": """WITH l AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS lang_id FROM (SELECT DISTINCT lang FROM documents WHERE doc_id % 2 = 0)), s AS (SELECT source, (row_number() OVER (ORDER BY source) - 1)::INTEGER AS source_id FROM (SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 0))
            SELECT 'doc_' || doc_id AS stem, lang, lang_id, source, source_id FROM documents LEFT JOIN l USING (lang) LEFT JOIN s USING (source) WHERE doc_id % 2 = 0""",
        "taxonomy_source": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')",
        "many_labels": """WITH l AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS lang_id FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)), s AS (SELECT source, (row_number() OVER (ORDER BY source) - 1)::INTEGER AS source_id FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
            SELECT doc_id, lang_id, source_id FROM documents LEFT JOIN l USING (lang) LEFT JOIN s USING (source)""",
        "many_roots": "WITH l AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS target FROM (SELECT DISTINCT lang FROM documents)) SELECT lang AS label, target, count(*) AS n FROM documents JOIN l USING (lang) GROUP BY 1, 2",
        "doubled_stems": "SELECT lang || '_' || (doc_id % 50) || ' of ' || source AS stem, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
        "checked_lookup": "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
        "chosen_columns": "SELECT p_partkey, p_brand, p_size FROM part",
        "not_nan_filter": "SELECT l_orderkey, l_linenumber, round(l_quantity, 6)::DOUBLE AS x FROM lineitem WHERE l_linenumber NOT IN (3, 5) AND l_quantity > 40 ORDER BY l_orderkey, l_linenumber LIMIT 100",
        "view_parts": "SELECT p_partkey, p_brand AS left, p_type AS right, p_partkey % 3 = 0 OR p_brand = 'other' AS same FROM part",
        "keyword_flags": "SELECT p_partkey, true AS named, false AS part_only, CASE WHEN p_partkey % 5 <> 0 THEN p_size::DOUBLE END AS low, (p_size + 3)::DOUBLE AS high FROM part",
        "label_line_parts": "SELECT p_partkey, p_name AS before, replace(p_brand, ' ', '_') AS after FROM part",
        "byte_sizes": "SELECT s_suppkey, CASE WHEN n >= 1e12 THEN format('{:,.1f} TB', n / 1e12) ELSE format('{:,.1f} GB', n / 1e9) END AS size FROM (SELECT s_suppkey, pow(s_suppkey::DOUBLE, 4) * 1e6 AS n FROM supplier)",
        "recent_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1",
        "close_values": "SELECT s_suppkey, s_suppkey % 8 NOT IN (2, 4) AS equal FROM supplier",
        "config_precedence": """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '0.9' WHEN n_nationkey % 2 = 0 THEN '0.5' ELSE '0.1' END AS lr, n_nationkey::VARCHAR AS k, CASE WHEN n_nationkey % 5 = 0 THEN 'typo' ELSE '' END AS unknown FROM nation""",
        "seeded_grid": "SELECT s_suppkey, round(s_acctbal, 2) AS lr, row_number() OVER (ORDER BY s_suppkey) + 6 AS seed FROM supplier",
        "config_changes": """SELECT c_custkey, 'lr' AS field, (c_custkey % 3)::VARCHAR AS value FROM customer WHERE c_custkey % 3 <> 1 UNION ALL SELECT c_custkey, 'model.kind', c_mktsegment FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'
            UNION ALL SELECT c_custkey, 'model.tied', 'false' FROM customer WHERE c_nationkey <= 12""",
        "ordered_config": "SELECT s_suppkey, 'layer' AS field, s_nationkey::VARCHAR AS value FROM supplier UNION ALL SELECT s_suppkey, 'tokens', s_name FROM supplier",
        "dead_from_state": b(", last AS (SELECT feature, coalesce(max(row), -1) AS l FROM features LEFT JOIN (SELECT * FROM codes WHERE value > 0.4) USING (feature) GROUP BY feature)", "SELECT feature, n - 1 - l AS since, n - 1 - l >= 100 AS dead FROM last, total"),
        "stochastic_percentile": """WITH RECURSIVE e AS (SELECT event_type, value::DOUBLE AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
            s AS (SELECT event_type, n, list(x ORDER BY i) AS xs FROM e GROUP BY event_type, n)
            SELECT event_type, n, round(list_reduce(xs, lambda est, x, k: est + 5.0 * (n - k) / n * (sign(x - est) + 2 * 90.0 / 100 - 1), 0.0::DOUBLE), 6) AS estimate FROM s""",
        "threshold_average": b(", bt AS (SELECT row // 50 AS batch, h FROM h QUALIFY row_number() OVER (PARTITION BY row // 50 ORDER BY h DESC, row, feature) <= 200), ls AS (SELECT batch, min(h) AS least FROM bt GROUP BY batch), ls2 AS (SELECT least, max(batch) OVER () - batch AS back FROM ls)", "SELECT round(sum(0.1 * pow(0.9, back) * least), 6) AS threshold FROM ls2"),
        "warmup_schedule": "SELECT p_partkey, round(CASE WHEN step < 100 THEN 0.01 * step / 100 ELSE 0.01 END, 6) AS rate FROM (SELECT p_partkey, p_partkey % 300 AS step FROM part)",
    }
