"""Input schemas of ticks, books and news."""

TICK = "timestamp TIMESTAMP, symbol STRING, price DOUBLE, volume DOUBLE, side STRING, trade_id STRING, sequence BIGINT, exchange STRING"
BOOK = "timestamp TIMESTAMP, symbol STRING, bids ARRAY<STRUCT<price: DOUBLE, size: DOUBLE, orders: INT>>, asks ARRAY<STRUCT<price: DOUBLE, size: DOUBLE, orders: INT>>, sequence BIGINT, exchange STRING"
NEWS = "timestamp TIMESTAMP, title STRING, impact STRING, actual STRING, forecast STRING, previous STRING, currency STRING"
TRADE_LOG = "timestamp TIMESTAMP, trade_id STRING, symbol STRING, side STRING, pnl DOUBLE, latency_ms DOUBLE, slippage_pips DOUBLE"
SIGNAL_LOG = "timestamp TIMESTAMP, signal_id STRING, symbol STRING, signal_type STRING, probability DOUBLE, features MAP<STRING, DOUBLE>"
