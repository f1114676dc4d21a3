"""SQL text shared by the oracle queries: the views of ``views.py`` once more."""

NORM = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}_''\-]+', ' ', 'g'))"

_SCORES = """
    round(list_sum(list_transform(range(1, {w} + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))
      / greatest(sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)))
               * sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE))), 1e-8), 6)
"""
_FOLDED = "list_transform(range(1, 33), lambda i: {0}.embedding[i] + {0}.embedding[i + 32])"

# name -> (names it needs, SQL)
CTES = {
    "words": (
        (),
        f"SELECT doc_id, lang AS category, string_split({NORM}, ' ') AS w FROM documents"
        f" WHERE {NORM} <> ''",
    ),
    "segments": (
        ("words",),
        "SELECT doc_id, category, s::BIGINT AS seg, list_slice(w, 20 * s + 1, 20 * s + 20) AS r"
        " FROM (SELECT *, unnest(range(0, (len(w) - 1) // 20 + 1)) AS s FROM words)",
    ),
    "utt": (
        ("segments",),
        """SELECT doc_id, seg, category, model, r, array_to_string(r, ' ') AS reference,
      length(array_to_string(r, ' ')) / 15.0::DOUBLE AS duration_seconds,
      (length(array_to_string(r, ' ')) * ms)::DOUBLE AS inference_time_ms,
      flatten(list_transform(range(0, len(r)), lambda i: CASE
        WHEN (i + doc_id + seg) % d2 = 5 THEN []::VARCHAR[]
        WHEN (i + doc_id + seg) % d1 = 3 THEN [reverse(r[i + 1])]
        WHEN (i + doc_id + seg) % d3 = 9 THEN [r[i + 1], 'eh']
        ELSE [r[i + 1]] END)) AS h
    FROM segments, (VALUES ('base', 7, 11, 13, 2), ('adapted', 11, 17, 19, 5)) m(model, d1, d2, d3, ms)""",
    ),
    # Word and character distances on ASCII-coded strings: the engine's own
    # levenshtein counts bytes.
    "scored_utt": (
        ("utt",),
        """SELECT * EXCLUDE (rc, hc, wv, cv),
      levenshtein(array_to_string(list_transform(r, lambda x: chr((32 + list_position(wv, x))::INT)), ''),
                  array_to_string(list_transform(h, lambda x: chr((32 + list_position(wv, x))::INT)), ''))
        / len(r)::DOUBLE AS wer,
      levenshtein(array_to_string(list_transform(rc, lambda x: chr((32 + list_position(cv, x))::INT)), ''),
                  array_to_string(list_transform(hc, lambda x: chr((32 + list_position(cv, x))::INT)), ''))
        / len(rc)::DOUBLE AS cer
    FROM (SELECT *, list_distinct(list_concat(r, h)) AS wv, list_distinct(list_concat(rc, hc)) AS cv
      FROM (SELECT *, string_split(reference, '') AS rc,
              list_filter(string_split(array_to_string(h, ' '), ''), lambda x: x <> '') AS hc FROM utt))""",
    ),
    # Common ends are taken off, then the distance table is filled row by row; a
    # cell carries its cost and the edits of the path that a trace back would take.
    "aligned": (
        ("scored_utt",),
        """SELECT *, length(ops) - length(replace(ops, 'E', '')) AS hits,
      length(ops) - length(replace(ops, 'S', '')) AS s,
      length(ops) - length(replace(ops, 'D', '')) AS d,
      length(ops) - length(replace(ops, 'I', '')) AS i
    FROM (SELECT *, repeat('E', head) || (list_reduce(r2,
        lambda above, x: list_reduce(range(1, len(h2) + 1), lambda acc, j: list_append(acc,
          CASE WHEN least(above[j + 1].c + 1, acc[j].c + 1, above[j].c + (h2[j] <> x)::INT) = above[j + 1].c + 1
                 THEN {'c': above[j + 1].c + 1, 'o': above[j + 1].o || 'D'}
               WHEN acc[j].c = above[j].c - 1 THEN {'c': acc[j].c + 1, 'o': acc[j].o || 'I'}
               ELSE {'c': above[j].c + (h2[j] <> x)::INT,
                     'o': above[j].o || CASE WHEN h2[j] = x THEN 'E' ELSE 'S' END} END),
          [{'c': above[1].c + 1, 'o': above[1].o || 'D'}]),
        list_transform(range(0, len(h2) + 1), lambda j: {'c': j::INT, 'o': repeat('I', j)})))[-1].o
        || repeat('E', tail) AS ops
      FROM (SELECT *, r1[1:len(r1) - tail] AS r2, h1[1:len(h1) - tail] AS h2
        FROM (SELECT *, coalesce(list_position(list_transform(range(0, least(len(r1), len(h1))),
                 lambda k: r1[len(r1) - k] = h1[len(h1) - k]), false) - 1, least(len(r1), len(h1))) AS tail
          FROM (SELECT *, r[head + 1:] AS r1, h[head + 1:] AS h1
            FROM (SELECT *, coalesce(list_position(list_transform(range(1, least(len(r), len(h)) + 1),
                     lambda k: r[k] = h[k]), false) - 1, least(len(r), len(h))) AS head FROM scored_utt)))))""",
    ),
    "edits": (
        ("aligned",),
        """SELECT doc_id, seg, model, k, op,
      CASE WHEN op <> 'I' THEN r[k - (length(ops[1:k]) - length(replace(ops[1:k], 'I', '')))] END AS rw,
      CASE WHEN op <> 'D' THEN h[k - (length(ops[1:k]) - length(replace(ops[1:k], 'D', '')))] END AS hw
    FROM (SELECT *, ops[k:k] AS op FROM (SELECT *, unnest(range(1, length(ops) + 1)) AS k FROM aligned))""",
    ),
    "runs": (
        ("edits",),
        """SELECT doc_id, seg, model, op, min(k) AS k, string_agg(rw, ' ' ORDER BY k) AS rs,
      string_agg(hw, ' ' ORDER BY k) AS hs
    FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id, seg, model, op ORDER BY k) AS island FROM edits)
    GROUP BY doc_id, seg, model, op, island""",
    ),
    "pairs": (
        (),
        f"""SELECT pair_id, pair_id AS input_pos, 'p' || pair_id AS id,
      ['paraphrase', 'topical_similarity', 'unrelated', 'contrast', 'informal', 'code_switching'][pair_id % 6 + 1] AS category,
      ['negation', 'tense', 'subject_agreement', 'argument_structure', 'quantification', 'code_switching',
       'informal_language'][pair_id % 7 + 1] AS phenomenon,
      ['meaning_change', 'temporal_change', 'participant_change', 'meaning_preserving',
       'approximately_meaning_preserving'][pair_id % 5 + 1] AS semantic_effect,
      'v' || (2 * pair_id) AS text_a, 'v' || (2 * pair_id + 1) AS text_b,
      {_SCORES.format(w=64, a="a", b="b")} AS sim_a, {_SCORES.format(w=32, a="fa", b="fb")} AS sim_b,
      (20 + pair_id % 7)::DOUBLE AS ms_a, (15 + pair_id % 11)::DOUBLE AS ms_b, a, b
    FROM (SELECT coalesce(x.vec_id, y.vec_id) // 2 AS pair_id, x.embedding AS a, y.embedding AS b,
        {_FOLDED.format("x")} AS fa, {_FOLDED.format("y")} AS fb
      FROM (SELECT * FROM embeddings WHERE vec_id % 2 = 0) x
      FULL JOIN (SELECT * FROM embeddings WHERE vec_id % 2 = 1) y ON y.vec_id = x.vec_id + 1)""",
    ),
    "long_pairs": (
        ("pairs",),
        """SELECT * EXCLUDE (a, b), 'encoder_a' AS model, sim_a AS similarity, round(1 - sim_a, 6) AS shift, ms_a AS ms, 64 AS width FROM pairs
    UNION ALL SELECT * EXCLUDE (a, b), 'encoder_b', sim_b, round(1 - sim_b, 6), ms_b, 32 FROM pairs""",
    ),
    "frames": (
        (),
        """SELECT vec_id, (vec_id // 60) * 3 + CASE WHEN vec_id % 60 < 16 THEN 0 WHEN vec_id % 60 < 36 THEN 1 ELSE 2 END AS clip_id,
      vec_id % 60 - CASE WHEN vec_id % 60 < 16 THEN 0 WHEN vec_id % 60 < 36 THEN 16 ELSE 36 END AS i,
      CASE WHEN vec_id % 60 < 16 THEN 30.0 ELSE 25.0 END AS fps,
      list_transform(range(0, 63), lambda d: CASE WHEN d >= 21 AND d < 42 AND vec_id % 4 = 0 THEN 0.0
        WHEN d < 3 AND vec_id % 7 = 0 THEN 0.0
        WHEN d = 62 THEN (embedding[63] + embedding[64])::DOUBLE ELSE embedding[d + 1]::DOUBLE END) AS x
    FROM embeddings""",
    ),
    "lengths": (("frames",), "SELECT clip_id, count(*) AS t FROM frames GROUP BY clip_id"),
    # Native values, long: clip, frame, feature, value.
    "native": (
        ("frames",),
        "SELECT clip_id, i, d, x[d + 1] AS v FROM (SELECT *, unnest(range(0, 63)) AS d FROM frames)",
    ),
    "source": (("native",), "SELECT clip_id, i, d - 21 AS d, v FROM native WHERE d >= 21"),
    "grid64": ((), "SELECT unnest(range(0, 64)) AS k"),
    "steps": (
        ("lengths", "grid64"),
        """SELECT clip_id, t, k, k * (t - 1) // 63 AS lo, least(k * (t - 1) // 63 + 1, t - 1) AS hi,
      ((k * (t - 1)) % 63) / 63.0::DOUBLE AS w FROM lengths, grid64""",
    ),
    "stats": (
        ("source",),
        """SELECT d, avg(v) AS mean, stddev_pop(v) AS std FROM source GROUP BY d
    UNION ALL SELECT unnest(range(42, 63)), 0.0, 0.0""",
    ),
}


def resampled(source: str) -> str:
    """Linear resampling of a long (clip_id, i, d, v) table to 64 frames."""
    return f"""SELECT s.clip_id, s.k, p.d, (p.v + (q.v - p.v) * s.w)::FLOAT::DOUBLE AS v
      FROM steps s JOIN {source} p ON p.clip_id = s.clip_id AND p.i = s.lo
      JOIN {source} q ON q.clip_id = s.clip_id AND q.i = s.hi AND q.d = p.d"""


def padded(table: str, keys: str = "clip_id, k") -> str:
    """Hand features of a long table plus zeros up to the model width."""
    return f"""SELECT {keys}, d, v FROM {table} UNION ALL
      SELECT {keys}, unnest(range(42, 63)), 0.0 FROM (SELECT DISTINCT {keys} FROM {table})"""


def standardised(table: str, keys: str = "clip_id, k") -> str:
    return f"""SELECT {keys}, d, ((v - mean)
      / CASE WHEN abs(std) < 1e-8 THEN 1.0 ELSE std END)::FLOAT::DOUBLE AS v FROM {table} JOIN stats USING (d)"""


def with_ctes(final: str, *names: str, **extra: str) -> str:
    """``final`` with the named CTEs, what they need, and extra ones after them."""
    ordered: list[str] = []

    def add(name):
        if name not in ordered:
            for needed in CTES[name][0]:
                add(needed)
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in ordered]
    parts += [f"{n} AS ({sql})" for n, sql in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + final
