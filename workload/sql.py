"""Building blocks of the SQL twins (DuckDB dialect).

They state each result in another way than the Spark operators do: windows
over whole symbols, and exponential means as self-joins over all earlier bars.
"""

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, body: str, *needs: str) -> None:
    PARTS[name] = (needs, body)


def sql(body: str, *needs: str) -> str:
    """A statement with the named parts, and what they need, in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in PARTS[name][0]:
            visit(n)
        order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return body
    # Each part once: inlined, the self-joins would be evaluated again and again. A part
    # that reads itself is a recursion.
    ctes = ",\n".join(
        f"{n} AS ({PARTS[n][1]})" if f"FROM {n} " in PARTS[n][1]
        else f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in order)
    return f"WITH RECURSIVE {ctes}\n{body}"


part("bars", """
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
    first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS "open",
    max(l_extendedprice) AS high, min(l_extendedprice) AS low,
    last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS "close",
    sum(l_quantity) AS volume
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""")

part("gappy", """
  SELECT symbol, date, "open", high, low,
    CASE WHEN volume >= 8 THEN "close" END AS "close", volume FROM bars""", "bars")

part("universe", """
  SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS name,
    CASE r_regionkey WHEN 0 THEN 'large' WHEN 1 THEN 'mid' WHEN 2 THEN 'small'
      ELSE 'us' END AS "group", n_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""")

part("num", """
  SELECT *, n - 1 - pos AS age FROM (
    SELECT *, row_number() OVER w - 1 AS pos, lag("close") OVER w AS prev_close,
      count(*) OVER (PARTITION BY symbol) AS n,
      first_value("close") OVER w AS first_close
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))""", "bars")

part("roll", """
  SELECT symbol, date, pos, n, age, "close", volume,
    CASE WHEN pos >= 4 THEN avg("close") OVER (w ROWS 4 PRECEDING) END AS sma5,
    CASE WHEN pos >= 19 THEN avg("close") OVER (w ROWS 19 PRECEDING) END AS sma20,
    CASE WHEN pos >= 49 THEN avg("close") OVER (w ROWS 49 PRECEDING) END AS sma50,
    CASE WHEN pos >= 19 THEN stddev_samp("close") OVER (w ROWS 19 PRECEDING) END AS std20,
    avg(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vol_avg
  FROM num WINDOW w AS (PARTITION BY symbol ORDER BY date)""", "num")

# Every earlier bar of a symbol, weighted by its distance.
part("ewm", """
  SELECT a.symbol, a.pos,
    sum(b."close" * pow(11.0::DOUBLE / 13, a.pos - b.pos)
      * CASE WHEN b.pos = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE / 13 END) AS ema12,
    sum(b."close" * pow(25.0::DOUBLE / 27, a.pos - b.pos)
      * CASE WHEN b.pos = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE / 27 END) AS ema26,
    sum(greatest(b."close" - b.prev_close, 0) * pow(13.0::DOUBLE / 14, a.pos - b.pos))
      AS gains,
    sum(greatest(b.prev_close - b."close", 0) * pow(13.0::DOUBLE / 14, a.pos - b.pos))
      AS losses,
    sum(pow(13.0::DOUBLE / 14, a.pos - b.pos)) FILTER (b.pos > 0) AS weights
  FROM num a JOIN num b ON a.symbol = b.symbol AND b.pos <= a.pos
  GROUP BY a.symbol, a.pos""", "num")

part("macd", """
  SELECT symbol, pos, ema12, ema26, ema12 - ema26 AS macd,
    CASE WHEN pos >= 14 THEN gains / weights END AS avg_gain,
    CASE WHEN pos >= 14 THEN losses / weights END AS avg_loss,
    CASE WHEN pos >= 14 AND gains + losses > 0
      THEN 100 - 100 / (1 + gains / nullif(losses, 0)) END AS rsi_plain,
    CASE WHEN pos >= 14 AND losses = 0 AND gains > 0 THEN 100.0::DOUBLE
      WHEN pos >= 14 AND gains + losses > 0
      THEN 100 - 100 / (1 + gains / nullif(losses, 0)) END AS rsi
  FROM ewm""", "ewm")

part("sig", """
  SELECT a.symbol, a.pos, any_value(a.macd) AS macd, any_value(a.rsi) AS rsi,
    sum(b.macd * pow(0.8::DOUBLE, a.pos - b.pos)
      * CASE WHEN b.pos = 0 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END) AS macd_signal
  FROM macd a JOIN macd b ON a.symbol = b.symbol AND b.pos <= a.pos
  GROUP BY a.symbol, a.pos""", "macd")

part("enriched", """
  SELECT n.symbol, n.date, n."open", n.high, n.low, n."close", n.volume,
    r.sma5, r.sma20, r.sma50, s.rsi, s.macd, s.macd_signal,
    s.macd - s.macd_signal AS macd_hist, r.sma20 AS bb_mid,
    r.sma20 + 2 * r.std20 AS bb_upper, r.sma20 - 2 * r.std20 AS bb_lower,
    n.pos, n.n, n.age, r.vol_avg
  FROM num n JOIN roll r USING (symbol, pos) JOIN sig s USING (symbol, pos)""",
     "num", "roll", "sig")

part("state", """
  SELECT l.*, p.macd AS prev_macd, p.macd_signal AS prev_signal
  FROM enriched l JOIN enriched p
    ON l.symbol = p.symbol AND l.age = 0 AND p.age = 1""", "enriched")

part("labels", """
  SELECT symbol, date AS last_date,
    CAST(printf('%.1f', "close") AS DOUBLE) AS "close",
    CAST(printf('%.1f', rsi) AS DOUBLE) AS rsi,
    CASE WHEN rsi IS NULL THEN 'na' WHEN rsi >= 70 THEN 'overbought'
      WHEN rsi <= 30 THEN 'oversold' ELSE 'neutral' END AS rsi_label,
    CASE WHEN prev_macd <= prev_signal AND macd > macd_signal THEN 'golden_cross'
      WHEN prev_macd >= prev_signal AND macd < macd_signal THEN 'dead_cross'
      WHEN macd > macd_signal THEN 'uptrend' ELSE 'downtrend' END AS macd_label,
    CASE WHEN sma5 > sma20 AND sma20 > sma50 THEN 'up'
      WHEN sma5 < sma20 AND sma20 < sma50 THEN 'down' ELSE 'flat' END AS trend,
    CASE WHEN "close" >= bb_upper THEN 'upper_touch'
      WHEN "close" <= bb_lower THEN 'lower_touch' ELSE '' END AS bb_signal,
    CAST(printf('%.2f', CASE WHEN vol_avg > 0 THEN volume / vol_avg ELSE 0 END)
      AS DOUBLE) AS vol_ratio,
    "close" AS last_close
  FROM state""", "state")

part("returns", """
  SELECT *, ln("close") - ln(prev_close) AS lr, isodow(date) - 1 AS weekday
  FROM num""", "num")

part("line", """
  SELECT symbol, regr_slope("close", x) AS slope, regr_intercept("close", x) AS base,
    max(m) AS m
  FROM (SELECT symbol, "close", least(n, 60) AS m,
      CAST(least(n, 60) - 1 - age AS DOUBLE) AS x FROM num WHERE age < 60)
  GROUP BY symbol""", "num")

part("ema20", """
  SELECT a.symbol, a.pos, any_value(a.age) AS age,
    sum(b."close" * pow(19.0::DOUBLE / 21, a.pos - b.pos)
      * CASE WHEN b.pos = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE / 21 END) AS ema
  FROM num a JOIN num b ON a.symbol = b.symbol AND b.pos <= a.pos
  GROUP BY a.symbol, a.pos""", "num")

part("drift", """
  SELECT a.symbol, (a.ema - b.ema) / 10 AS drift
  FROM ema20 a JOIN ema20 b ON a.symbol = b.symbol AND a.age = 0 AND b.age = 10""",
     "ema20")

part("sigma", """
  SELECT symbol, stddev_samp(lr) AS sigma FROM returns WHERE age < 120
  GROUP BY symbol""", "returns")

part("effect", """
  SELECT symbol, weekday, avg(lr) - any_value(m) AS dev
  FROM (SELECT *, avg(lr) OVER (PARTITION BY symbol) AS m FROM returns
    WHERE age < 250)
  WHERE lr IS NOT NULL GROUP BY symbol, weekday""", "returns")

part("last_rows", """
  SELECT symbol, date AS last_date, "close" AS last_close FROM num WHERE age = 0""",
     "num")

part("steps", """
  SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) AS step
  FROM (SELECT symbol, CAST(start + CAST(i AS INTEGER) AS DATE) AS day
    FROM (SELECT symbol, CASE WHEN isodow(last_date) >= 6
        THEN last_date + CAST(8 - isodow(last_date) AS INTEGER)
        ELSE last_date END AS start FROM last_rows),
      range(1, 8) t(i))
  WHERE isodow(day) < 6""", "last_rows")

part("shift", """
  SELECT s.symbol, s.step, s.day,
    sum(coalesce(e.dev, 0)) OVER (PARTITION BY s.symbol ORDER BY s.step) AS adj
  FROM steps s LEFT JOIN effect e
    ON s.symbol = e.symbol AND e.weekday = isodow(s.day) - 1
  WHERE s.step <= 5""", "steps", "effect")


def arima_run(w: str, phi: str, theta: str) -> str:
    """State of the one-step predictor after the list w: ahead, scale, sq, lg."""
    start = (f"{{'v': 0.0::DOUBLE, 'ahead': 0.0::DOUBLE, 'scale': (1.0::DOUBLE + 2.0 * {phi}"
             f" * {theta} + {theta} * {theta}) / (1.0::DOUBLE - {phi} * {phi}),"
             f" 'sq': 0.0::DOUBLE, 'lg': 0.0::DOUBLE, 'phi': {phi}, 'theta': {theta}}}")
    entry = (f"{{'v': x, 'ahead': 0.0::DOUBLE, 'scale': 0.0::DOUBLE, 'sq': 0.0::DOUBLE,"
             f" 'lg': 0.0::DOUBLE, 'phi': {phi}, 'theta': {theta}}}")
    step = """{'v': x.v, 'ahead': s.phi * x.v + s.theta * (x.v - s.ahead) / s.scale,
      'scale': 1.0::DOUBLE + s.theta * s.theta - s.theta * s.theta / s.scale,
      'sq': s.sq + (x.v - s.ahead) * (x.v - s.ahead) / s.scale,
      'lg': s.lg + ln(s.scale), 'phi': s.phi, 'theta': s.theta}"""
    return (f"list_reduce(list_concat([{start}], list_transform({w}, lambda x : {entry})),"
            f" lambda s, x : {step})")


COST = """{'cost': n * ln(greatest(run.sq, 1e-300::DOUBLE) / n) + run.lg, 'k': k,
    'a': a, 'b': b}"""

part("log_moves", """
  SELECT symbol, list(lr ORDER BY pos) AS w, count(*)::DOUBLE AS n,
    max_by(ln("close"), pos) AS last
  FROM returns WHERE age < 249 AND lr IS NOT NULL GROUP BY symbol
  HAVING count(*) >= 10""", "returns")

# The same search as a recursion over rounds: a grid, then steps that halve where none of
# the eight neighbours is better.
part("arima_grid", f"""
  SELECT symbol, min({COST}) AS best
  FROM (SELECT *, {arima_run('w', 'tanh(a)', 'tanh(b)')} AS run
    FROM log_moves, (SELECT r * 7 + c AS k,
        CASE c WHEN 6 THEN 1.8::DOUBLE ELSE c * (3.6::DOUBLE / 6) - 1.8::DOUBLE END AS a,
        CASE r WHEN 6 THEN 1.8::DOUBLE ELSE r * (3.6::DOUBLE / 6) - 1.8::DOUBLE END AS b
      FROM range(7) t(c), range(7) u(r)))
  GROUP BY symbol""", "log_moves")

part("arima_rounds", f"""
  SELECT symbol, 0 AS round, best.a AS a, best.b AS b, best.cost AS low,
    0.3::DOUBLE AS step FROM arima_grid
  UNION ALL
  SELECT symbol, round + 1,
    CASE WHEN near.cost < low - 1e-12::DOUBLE THEN near.a ELSE a END,
    CASE WHEN near.cost < low - 1e-12::DOUBLE THEN near.b ELSE b END,
    CASE WHEN near.cost < low - 1e-12::DOUBLE THEN near.cost ELSE low END,
    CASE WHEN near.cost < low - 1e-12::DOUBLE THEN step ELSE step / 2 END
  FROM (SELECT symbol, any_value(round) AS round, any_value(at_a) AS a,
      any_value(at_b) AS b, any_value(low) AS low, any_value(step) AS step,
      min({COST}) AS near
    FROM (SELECT *, {arima_run('w', 'tanh(a)', 'tanh(b)')} AS run
      FROM (SELECT g.symbol, g.round, g.a AS at_a, g.b AS at_b, g.low, g.step, m.w, m.n,
          j * 3 + i AS k,
          greatest(least(g.a + g.step * (i - 1), 5.0::DOUBLE), -5.0::DOUBLE) AS a,
          greatest(least(g.b + g.step * (j - 1), 5.0::DOUBLE), -5.0::DOUBLE) AS b
        FROM arima_rounds g JOIN log_moves m ON g.symbol = m.symbol,
          range(3) t(i), range(3) u(j)
        WHERE g.step >= 1e-5::DOUBLE AND g.round < 50))
    GROUP BY symbol)""", "arima_grid", "log_moves")

part("third", f"""
  SELECT symbol, last, run.ahead AS ahead, tanh(b) AS theta, tanh(a) AS phi
  FROM (SELECT *, {arima_run('w', 'tanh(a)', 'tanh(b)')} AS run
    FROM (SELECT symbol, max_by(a, round) AS a, max_by(b, round) AS b
      FROM arima_rounds GROUP BY symbol) JOIN log_moves USING (symbol))""",
     "arima_rounds", "log_moves")

part("third_path", """
  SELECT symbol, CAST(s AS INTEGER) AS step,
    exp(last + list_sum(list_transform(range(s), lambda i : ahead * pow(phi, i)))) AS value
  FROM third, range(1, 6) t(s)""", "third")

for suffix, joined, level in (
        ("", "", "two / 2"),
        ("_three", "LEFT JOIN third_path v ON v.symbol = h.symbol AND v.step = h.step",
         "CASE WHEN v.value IS NULL THEN two / 2 ELSE (two + v.value) / 3 END")):
    part(f"path{suffix}", f"""
  SELECT symbol, step, day AS date,
    round_even(value * 10, 0) / 10 AS forecast,
    round_even(value * exp(-margin) * 10, 0) / 10 AS lower,
    round_even(value * exp(margin) * 10, 0) / 10 AS upper, last_close
  FROM (SELECT h.symbol, h.step, h.day, h.last_close,
      {level} * exp(h.adj) AS value, 1.96::DOUBLE * h.sigma * sqrt(h.step) AS margin
    FROM (SELECT h.symbol, CAST(h.step AS INTEGER) AS step, h.day, l.last_close, h.adj,
        g.sigma, (f.base + f.slope * (f.m - 1 + h.step))
          + (l.last_close + d.drift * h.step) AS two
      FROM shift h JOIN line f USING (symbol) JOIN drift d USING (symbol)
        JOIN sigma g USING (symbol) JOIN last_rows l USING (symbol)) h {joined})""",
         "shift", "line", "drift", "sigma", "last_rows", *(["third_path"] if suffix else []))

    part(f"week{suffix}", f"""
  SELECT symbol, forecast AS forecast_1w,
    CAST(printf('%.2f', (forecast / last_close - 1) * 100) AS DOUBLE)
      AS forecast_1w_pct, lower AS forecast_lower, upper AS forecast_upper
  FROM path{suffix} WHERE step = 5""", f"path{suffix}")

    part(f"summary{suffix}", f"""
  SELECT l.symbol, coalesce(u.name, l.symbol) AS name,
    coalesce(u."group", '?') AS "group", coalesce(u.sector, '?') AS sector,
    l.last_date, l."close", l.rsi, l.rsi_label, l.macd_label, l.trend, l.bb_signal,
    l.vol_ratio, w.forecast_1w, w.forecast_1w_pct, w.forecast_lower,
    w.forecast_upper
  FROM labels l JOIN week{suffix} w USING (symbol) LEFT JOIN universe u USING (symbol)""",
         "labels", f"week{suffix}", "universe")

part("windows", """
  SELECT symbol, e, date AS end_date, start_date, win, nxt, last, m, sd,
    row_number() OVER (PARTITION BY symbol ORDER BY e) - 1 AS widx
  FROM (SELECT symbol, pos + 1 AS e, date, "close" AS last,
      min(date) OVER (w ROWS 59 PRECEDING) AS start_date,
      list("close") OVER (w ROWS 59 PRECEDING) AS win,
      list("close") OVER (w ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS nxt,
      avg("close") OVER (w ROWS 59 PRECEDING) AS m,
      stddev_pop("close") OVER (w ROWS 59 PRECEDING) AS sd, n
    FROM num WINDOW w AS (PARTITION BY symbol ORDER BY date))
  WHERE e >= 60 AND (e - 60) % 5 = 0 AND e < n - 20 AND sd >= 1e-9""", "num")

part("shapes", """
  SELECT query_id, list_transform(q, lambda x : (x - m) / sd) AS zq, from_date
  FROM (SELECT symbol AS query_id, list("close" ORDER BY pos) AS q,
      avg("close") AS m, stddev_pop("close") AS sd, min(date) AS from_date
    FROM num WHERE age < 60 AND symbol IN ('1', '2') GROUP BY symbol)
  WHERE sd >= 1e-9""", "num")

# All windows against each shape, and the greedy choice: a fold over the best
# 100 * (2 * 6 - 1) windows of a query. Shapes are the last bars of a symbol, so a window
# overlaps its shape if it ends after the shape's first bar.
for suffix, which in (("", "true"), (
        "_elsewhere", "w.symbol <> s.query_id OR w.end_date < s.from_date")):
    part(f"scored{suffix}", f"""
  SELECT s.query_id, w.symbol, w.widx, w.end_date,
    list_dot_product(list_transform(w.win, lambda x : (x - w.m) / w.sd), s.zq) / 60
      AS sim,
    list_transform(w.nxt, lambda x : x / w.last - 1) AS fut
  FROM windows w, shapes s WHERE {which}""", "windows", "shapes")
    part(f"taken{suffix}", f"""
  SELECT query_id, list_reduce(
      list([{{'symbol': symbol, 'widx': widx, 'end_date': end_date, 'sim': sim,
             'fut': fut}}] ORDER BY place),
      lambda a, x : CASE WHEN len(a) < 100 AND len(list_filter(a, lambda y :
          y.symbol = x[1].symbol AND abs(y.widx - x[1].widx) < 6)) = 0
        THEN list_concat(a, x) ELSE a END) AS rows
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY sim DESC, symbol, widx DESC) AS place FROM scored{suffix})
  WHERE place <= 1100 GROUP BY query_id""", f"scored{suffix}")
    part(f"chosen{suffix}", f"""
  SELECT query_id, i AS rank, len(rows) AS n, rows[i].symbol AS symbol,
    rows[i].widx AS widx, rows[i].end_date AS end_date, rows[i].sim AS sim,
    rows[i].fut AS fut
  FROM (SELECT query_id, rows, unnest(range(1, len(rows) + 1)) AS i FROM taken{suffix}
    WHERE len(rows) >= 10)""", f"taken{suffix}")

part("listing_a", """
  SELECT list_extract(['Prime (内国株式)', 'Standard (内国株式)', 'ETF'],
      p_size % 3 + 1) AS market,
    list_extract(['TOPIX Core30', 'TOPIX Large70', 'TOPIX Mid400', 'TOPIX Small 1',
      'TOPIX Small 2', '-'], CAST(floor(p_size / 3) AS INTEGER) % 6 + 1) AS size,
    p_partkey AS code, ' ' || p_name || ' ' AS name, p_type AS sector FROM part""")

part("listing_b", """
  SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey || '.B'
      ELSE ' ' || p_partkey || '-T' END AS symbol,
    p_name AS security, p_brand AS sector FROM part""")

part("exchange", """
  SELECT trim(CAST(code AS VARCHAR)) || '.T' AS symbol, trim(name) AS name,
    CASE size WHEN 'TOPIX Core30' THEN 'large' WHEN 'TOPIX Large70' THEN 'large'
      WHEN 'TOPIX Mid400' THEN 'mid' WHEN 'TOPIX Small 1' THEN 'small' END AS "group",
    trim(sector) AS sector
  FROM listing_a WHERE market LIKE '%内国株式%' AND size IN ('TOPIX Core30',
    'TOPIX Large70', 'TOPIX Mid400', 'TOPIX Small 1')""", "listing_a")

part("constituents", """
  SELECT replace(trim(symbol), '.', '-') AS symbol, trim(security) AS name,
    'us' AS "group", trim(sector) AS sector FROM listing_b""", "listing_b")

part("both_lists", """
  SELECT symbol, name, "group", sector FROM (
    SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY symbol, name, sector)
      AS i FROM exchange) WHERE "group" <> 'small' OR i <= 100
  UNION ALL SELECT * FROM constituents""", "exchange", "constituents")

part("built", """
  SELECT symbol, name, "group", sector FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE "group"
      WHEN 'large' THEN 0 WHEN 'mid' THEN 1 WHEN 'small' THEN 2 ELSE 3 END,
      name, sector) AS i FROM both_lists) WHERE i = 1""", "both_lists")
