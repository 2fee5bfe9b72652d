"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from sillage.llm.chat import BEGIN, CONTROL, MARKS, OTHER


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped_length(x: str) -> str:
    """Characters of x once escaped: one more for each backslash and each control string."""
    more = [f"(length({x}) - length(replace({x}, '\\', '')))"]
    more += [f"(length({x}) - length(replace({x}, {_quoted(c)}, ''))) // {len(c)}" for c in CONTROL]
    return f"(length({x}) + {' + '.join(more)})"


_frame = "CASE role " + " ".join(f"WHEN '{k}' THEN {len(a) + len(b)}" for k, (a, b) in MARKS.items())
_FRAME = f"{_frame} ELSE {sum(map(len, OTHER))} + {_escaped_length('role')} END"

CHAT = f"""WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, COUNT(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(SUM(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST({len(BEGIN)} + SUM({_FRAME} + {_escaped_length('text')}) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id"""

#: Phrases of 1 to 4 words from all places of all pieces; cuts, the lowest score, what longer phrases replace.
PHRASES = """WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\\x20\\x09]+') IF x <> ''] AS w FROM pieces),
grams AS (SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, COUNT(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, SUM(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
cuts AS (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < m),
scores AS (SELECT cuts.lang, cuts.m, cuts.phrase, a, k, x.f AS l, y.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p JOIN f y ON y.lang = cuts.lang AND y.phrase = q),
low AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, a, unnest([array_to_string(w[i:i + s - 1], ' ') FOR i IN range(1, m - s + 2)]) AS phrase FROM c, (SELECT unnest([2, 3]) AS s) WHERE s < m),
held AS (SELECT lang, phrase, MAX(a) AS longest FROM parts GROUP BY ALL),
kept AS (SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, encode(low.phrase)) AS rank
  FROM low LEFT JOIN held ON held.lang = low.lang AND held.phrase = low.phrase WHERE longest IS NULL OR 100 * longest < 80 * a)
SELECT kept.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM kept JOIN n ON n.lang = kept.lang WHERE rank <= 2000"""

ORACLES: dict[str, str] = {"op6_chat_formatting": CHAT, "op11_phrase_mining": PHRASES}
