"""The splitting of locha.split_large in SQL: tiles of very large clusters, then rounds of k-means.

Points on one spot of a tile always go together, so a spot stands for them, with its weight and its least id. Sums of coordinates
are exact for whole numbers, and then parts agree to the last one.
"""


def _square(a: str, b: str) -> str:
    return f"(({a}['x'] - {b}['x']) * ({a}['x'] - {b}['x']) + ({a}['y'] - {b}['y']) * ({a}['y'] - {b}['y']))"


def _round(n: int, most: int, radius: float, turns: int) -> list[str]:
    """The n-th round: its groups, the steps of k-means over them (a seed more, or a turn), and the spots with their parts after it."""
    where = lambda of, l: f"list_position({l}, list_{of}({l}))"
    spot = lambda i: f"{{'x': p[{i}]['x'], 'y': p[{i}]['y']}}"
    total = lambda v: f"list_sum(list_transform(p, lambda a, i: CASE WHEN label[i] = j THEN {v} ELSE 0 END))"
    weight = total("a['w']")
    x, y = (f"{total(f'{v} * a' + suffix)} / {weight}" for v, suffix in (("a['x']", "['w']"), ("a['y']", "['w']")))
    groups = f"""groups{n} AS (SELECT cluster, part, list({{'x': x, 'y': y, 'w': w, 'i': i}} ORDER BY i) AS p, CAST(sum(w) AS BIGINT) AS n, {{'x': sum(x * w) / sum(w), 'y': sum(y * w) / sum(w)}} AS m
  FROM spots{n - 1} GROUP BY cluster, part{f" HAVING sum(w) > {most}" if n > 1 else ""})"""
    steps = f"""steps{n} AS (
  SELECT cluster, part, CAST(ceil(n / {most}) AS BIGINT) AS k, [{spot(where("min", "d"))}] AS seeds, NULL::STRUCT(x DOUBLE, y DOUBLE)[] AS c, 0 AS turn, NULL::BIGINT[] AS label
  FROM (SELECT *, list_transform(p, lambda a: {_square("a", "m")}) AS d FROM groups{n})
  UNION ALL
  SELECT cluster, part, CASE WHEN ended AND NOT good THEN k + 1 ELSE k END, CASE WHEN far IS NOT NULL THEN list_append(seeds, {spot(where("max", "far"))}) ELSE seeds END,
    CASE WHEN NOT ended THEN new END, CASE WHEN NOT ended THEN turn + 1 ELSE 0 END, CASE WHEN ended AND good THEN label END
  FROM (SELECT *, ended AND (k >= n OR sqrt(list_max(list_transform(p, lambda a, i: {_square("a", "new[label[i]]")}))) <= {radius}) AS good
  FROM (SELECT *, label IS NOT NULL AND (new = c OR turn + 1 = {turns}) AS ended
  FROM (SELECT *, CASE WHEN label IS NOT NULL THEN list_transform(c, lambda q, j: CASE WHEN list_contains(label, j) THEN {{'x': {x}, 'y': {y}}} ELSE q END) END AS new
  FROM (SELECT *, CASE WHEN len(seeds) = k THEN list_transform(d, lambda l: {where("min", "l")}) END AS label, CASE WHEN len(seeds) < k THEN list_transform(d, lambda l: list_min(l)) END AS far
  FROM (SELECT *, list_transform(p, lambda a: list_transform(c, lambda q: {_square("a", "q")})) AS d
  FROM (SELECT s.cluster, s.part, k, seeds, CASE WHEN c IS NULL THEN 0 ELSE turn END AS turn, p, n, coalesce(c, seeds) AS c FROM steps{n} s JOIN groups{n} USING (cluster, part) WHERE label IS NULL)))))))"""
    rest = f"\n  UNION ALL SELECT * FROM spots{n - 1} WHERE (cluster, part) NOT IN (SELECT (cluster, part) FROM groups{n})" if n > 1 else ""
    spots = f"""spots{n} AS (
  SELECT cluster, part || '/' || label[j] AS part, p[j]['x'] AS x, p[j]['y'] AS y, p[j]['w'] AS w, p[j]['i'] AS i
  FROM (SELECT s.*, p, unnest(range(1, len(p) + 1)) AS j FROM steps{n} s JOIN groups{n} USING (cluster, part) WHERE label IS NOT NULL){rest})"""
    return [groups, steps, spots]


def split(points: str, most: int, radius: float, rounds: int = 5, turns: int = 20, at_once: int = 5000, halvings: int = 16) -> list[str]:
    """Tables that end in parted (id, cluster, part), from a table of points (id, cluster, x, y)."""
    cell = lambda v: f"CAST(floor({v} / ({2 * radius} / 2.0 ** k)) AS BIGINT)"
    share = "CAST(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8)) AS BIGINT)"
    return [
        f"sized AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS size FROM {points})",
        f"cells AS (SELECT id, cluster, k, k || ':' || {cell('x')} || ':' || {cell('y')} AS tile FROM sized, range({halvings + 1}) r(k) WHERE size > {at_once})",
        "full_cells AS (SELECT *, count(*) OVER (PARTITION BY cluster, tile) AS n FROM cells)",
        f"first_cells AS (SELECT id, min_by(tile, k) AS tile, min_by(n, k) AS n FROM full_cells WHERE n <= {at_once} OR k = {halvings} GROUP BY id)",
        f"tiles AS (SELECT id, tile || CASE WHEN n > {at_once} THEN ':' || {share} % CAST(ceil(n / {at_once}) AS BIGINT) ELSE '' END AS tile FROM first_cells)",
        "tiled AS (SELECT s.*, coalesce(tile, '') AS tile FROM sized s LEFT JOIN tiles USING (id))",
        "spots0 AS (SELECT cluster, tile AS part, x, y, count(*) AS w, min(id) AS i FROM tiled GROUP BY ALL)",
        *(table for n in range(1, rounds + 1) for table in _round(n, most, radius, turns)),
        f"parted AS (SELECT t.id, t.cluster, s.part FROM tiled t JOIN spots{rounds} s ON s.cluster = t.cluster AND s.x = t.x AND s.y = t.y AND split_part(s.part, '/', 1) = t.tile)",
    ]
