"""The SQL twin of the conversation repair: the cheapest repair by plain recursion over rows,
carrying cost and audit of every state as one string."""

from __future__ import annotations

BLANK = r"[\x20\x09-\x0D]"


def _add(x: str, cost: str, letters: str) -> str:
    return f"lpad(CAST(CAST(substr({x}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{letters}' || substr({x}, 10)"


def _edits(state: str, keeps: dict[str, str], following: str) -> str:
    """The cheapest edit of one row in ``state``, before any insertion."""
    kept = " ".join(f"WHEN i = '{i}' THEN {_add(x, 'cut', 'K')}" for i, x in keeps.items())
    return (
        f"least({_add(state, '3', 'D')}, CASE WHEN gone THEN NULL {kept} END, "
        f"CASE WHEN NOT gone THEN {_add(following, '2 + cut', 'R')} END) AS b{state}"
    )


REPAIR = f"""
    WITH RECURSIVE
    bits(i, v, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL
      SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
    byte_sums AS (SELECT i, v FROM bits WHERE k = 8),
    keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
    sums(name, k, c) AS (SELECT DISTINCT name, 0, 4294967295 FROM keyed UNION ALL
      SELECT name, k + 1, xor(c >> 8, v) FROM sums JOIN byte_sums ON i = xor(c, ascii(substr(name, k + 1, 1))) & 255
      WHERE k < length(name)),
    faulty AS (SELECT d.*, xor(s.c, 4294967295) % 20 AS fault FROM keyed d JOIN sums s ON s.name = d.name AND s.k = length(s.name)),
    damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
      CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
      unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM faulty WHERE fault <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n FROM damaged),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
      NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, regexp_matches(text, '[.!?]{BLANK}*\\z') AS ended,
      substr(role, 1, 1) AS i, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
    marked AS (SELECT *, blank OR again AS gone, CAST(NOT blank AND NOT again AND NOT ended AS INT) AS cut FROM seen),
    facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
      count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
      sum(cut) AS truncated, count(*) FILTER (WHERE n > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
      FROM marked GROUP BY conv_id),
    costs(conv_id, k, e, s, u, a) AS (
      SELECT conv_id, n, '000000000', '000000004II', '000000002I', '000000000' FROM facts
      UNION ALL
      SELECT conv_id, k - 1, least(be, {_add("bu", "2", "I")}, {_add("ba", "4", "II")}),
        least(bs, {_add("bu", "2", "I")}, {_add("ba", "4", "II")}), least(bu, {_add("ba", "2", "I")}),
        least(ba, {_add("bu", "2", "I")})
      FROM (SELECT c.conv_id, k,
        {_edits("e", {"s": "s", "u": "u"}, "u")}, {_edits("s", {"u": "u"}, "u")},
        {_edits("u", {"a": "a"}, "a")}, {_edits("a", {"u": "u"}, "u")}
        FROM costs c JOIN marked m ON m.conv_id IS NOT DISTINCT FROM c.conv_id AND m.n = c.k)),
    best AS (SELECT conv_id, CAST(substr(e, 1, 9) AS BIGINT) AS cost, substr(e, 10) AS audit FROM costs WHERE k = 0),
    edits AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best),
    spread AS (SELECT conv_id, p, substr(audit, p, 1) AS edit,
      length(replace(substr(audit, 1, p), 'I', '')) AS n, length(replace(substr(audit, 1, p), 'D', '')) AS j FROM edits),
    turns AS (SELECT x.conv_id, j, edit, m.role, m.text,
      max(CAST(j = 1 AND edit = 'K' AND i = 's' AS INT)) OVER (PARTITION BY x.conv_id) AS opened
      FROM spread x LEFT JOIN marked m ON x.edit <> 'I' AND m.conv_id IS NOT DISTINCT FROM x.conv_id AND m.n = x.n
      WHERE edit <> 'D'),
    said AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END
      || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h FROM turns GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
      coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN said t ON t.conv_id IS NOT DISTINCT FROM o.conv_id"""
