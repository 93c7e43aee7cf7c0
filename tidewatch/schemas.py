"""Schemas of the engine's tables. Times are unix seconds (UTC); a null statistic means "unknown"."""

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, MapType, ShortType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v, True) for k, v in fields.items()])


_L, _D, _S, _I = LongType(), DoubleType(), StringType(), IntegerType()

HISTORY = _struct(itemid=_L, clock=_L, value=_D)
TRENDS = _struct(itemid=_L, clock=_L, value_min=_D, value_avg=_D, value_max=_D)
ITEMS = _struct(group_name=_S, hostid=_L, host_name=_S, itemid=_L, item_name=_S, units=_S, key_=_S)
EVENTS = _struct(clock=_L, host_name=_S, severity=_I, name=_S)
STATS = _struct(itemid=_L, sum=_D, sqr_sum=_D, cnt=_L, mean=_D, std=_D, last_clock=_L, zero_cnt=_L, max_value=_D, intra_std=_D, local_peak=_D, peak_episodes=_L)
PANES = _struct(itemid=_L, pane=_L, n=_L, mean=_D, m2=_D, max_value=_D, zero_cnt=_L, last_clock=_L, spread=_D, spread_n=_L)
HOUR_STATS = _struct(itemid=_L, hour_of_day=ShortType(), mean=_D, std=_D, cnt=_L)
ANOMALIES = _struct(
    itemid=_L, created=_L, group_name=_S, hostid=_L, clusterid=_I, host_name=_S, item_name=_S,
    trend_mean=_D, trend_std=_D, score=_D, detector_scores=MapType(_S, _D), rescued=BooleanType(),
)
UPDATES = _struct(startep=_L, endep=_L)
LABELS = _struct(item_id=_L, label=_I, note=_S, incident=_S, confidence=_D)
MASTER = _struct(host_name=_S, key_=_S, label=_I, note=_S, incident=_S, confidence=_D, date=_S)
CLUSTERS = _struct(itemid=_L, clusterid=_I)
ONSETS = _struct(itemid=_L, onset=_L)
