"""Typed configuration with the shipped defaults; YAML files are merged over them, source by source."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any, Literal, get_args, get_origin, get_type_hints


@dataclass(frozen=True)
class Magnitude:
    mode: Literal["relative", "sigma", "absolute"] = "relative"
    lo: float = 0.0
    hi: float = 1.0
    floor: float = 0.0


@dataclass(frozen=True)
class Category:
    name: str = "default"
    key_patterns: tuple[str, ...] = ()
    weight: float | None = None
    magnitude: Magnitude | None = None


@dataclass(frozen=True)
class Duration:
    enabled: bool = True
    measure: Literal["count", "consecutive"] = "count"
    sigma: float = 2.0
    lo_secs: float = 600
    hi_secs: float = 3600
    floor: float = 0.0


@dataclass(frozen=True)
class IdleBaseline:
    enabled: bool = True
    max_zero_ratio: float = 0.8
    floor: float = 0.0


@dataclass(frozen=True)
class Recency:
    enabled: bool = True
    max_age_secs: int = 0
    floor: float = 0.0


@dataclass(frozen=True)
class RecurringPeak:
    enabled: bool = True
    min_episodes: int = 9
    k_sigma: float = 2.0
    exclude_recent_secs: int = 86400
    floor: float = 0.0


def _m(mode: str, lo: float, hi: float) -> Magnitude:
    return Magnitude(mode, lo, hi)


#: Metric categories; the first whose pattern matches a key wins.
CATEGORIES = (
    Category("container_cpu", ("docker.container_stats.cpu_usage.*",), 1.0, _m("relative", 0.3, 1.0)),
    Category("packets", ("docker.networks.*packets*", "net.if.*packets*", "vmware.vm.net.*packets*"), 0.6, _m("relative", 0.3, 1.0)),
    Category("session_traffic", ("*session*traffic*",), 0.6, _m("relative", 0.3, 1.0)),
    Category("network", ("net.if.*", "vmware.vm.net.*", "vmware.hv.network.*", "docker.networks.*"), 0.2, _m("absolute", 1048576, 10485760)),
    Category("cpu_load", ("system.cpu.load*",), 1.0, _m("absolute", 1, 4)),
    Category("cpu_perf", ("vmware.vm.cpu.usage.perf*",), 1.0, _m("absolute", 10, 40)),
    Category("cpu_hz", ("vmware.vm.cpu.*",), 1.0, _m("relative", 0.5, 1.5)),
    Category("cpu", ("system.cpu.util*",), 1.0, _m("absolute", 10, 40)),
    Category("memory_pct", ("vm.memory.util*", "vm.memory.pusage*", "*.pusage*"), 0.7, _m("absolute", 5, 30)),
    Category("memory_bytes", ("vm.memory.size*", "vm.memory.free*", "vm.memory.used*", "vm.memory.buffers*", "proc.mem*", "docker.container_stats.memory.usage*"), 0.7, _m("relative", 0.1, 0.5)),
    Category("disk", ("vfs.fs.*", "vfs.dev.*", "truenas.dataset.*", "truenas.zpool.*", "vmware.vm.vfs.dev.*", "vmware.vm.storage.*", "vmware.hv.datastore.*"), 0.5, _m("relative", 0.05, 0.3)),
    Category("default", ("*",), 1.0, _m("relative", 0.5, 1.0)),
)


@dataclass(frozen=True)
class MetricCategories:
    default_weight: float = 1.0
    duration: Duration = Duration()
    idle_baseline: IdleBaseline = IdleBaseline()
    recency: Recency = Recency()
    recurring_peak: RecurringPeak = RecurringPeak()
    categories: tuple[Category, ...] = CATEGORIES


@dataclass(frozen=True)
class ZScore:
    enabled: bool = True
    weight: float = 0.3
    lambda_threshold: float = 3.0
    min_ignore_rate: float = 0.05


@dataclass(frozen=True)
class Changepoint:
    enabled: bool = True
    weight: float = 0.3
    cusum_h: float = 5.0
    cusum_k: float = 0.5


@dataclass(frozen=True)
class Seasonal:
    enabled: bool = True
    weight: float = 0.4
    lambda_threshold: float = 3.0


@dataclass(frozen=True)
class Detectors:
    zscore: ZScore = ZScore()
    changepoint: Changepoint = Changepoint()
    seasonal: Seasonal = Seasonal()


@dataclass(frozen=True)
class Ensemble:
    min_score: float = 0.7
    require_any: int = 2


@dataclass(frozen=True)
class Clustering:
    linkage: Literal["complete", "average", "dbscan"] = "complete"
    corr_eps: float = 0.30
    min_corr_points: int = 8
    raw_corr_min: float = 0.99
    min_samples: int = 2
    sigma: float = 2.0
    detection_period: int = 43200
    max_onset_gap: int = 7200
    onset_level_tol: float = 0.1
    onset_tolerance: int = 2
    onset_recent_samples: int = 3
    max_items: int = 5000
    rescue_same_incident: bool = True


@dataclass(frozen=True)
class ItemFilter:
    name: str = ""
    key_pattern: str = ""
    units: str = ""
    min_value: float | None = None


@dataclass(frozen=True)
class AnomalyFilter:
    name: str = ""
    key_pattern: str = ""
    units: str = ""
    min_abs_diff: float | None = None


@dataclass(frozen=True)
class WatchRule:
    key_pattern: str = ""
    host_pattern: str = ""


@dataclass(frozen=True)
class FastDetect:
    enabled: bool = False
    watch: tuple[WatchRule, ...] = ()
    history_span_secs: int = 3600
    detect_window: int = 4
    lambda_threshold: float = 3.0
    min_item_score: float = 0.5
    seasonal_veto: bool = True
    seasonal_lambda: float = 3.0
    cooccur: bool = True
    use_events: bool = False
    events_window_secs: int = 0
    events_saturation: float = 3.0
    min_event_score: float = 0.5
    output_path: str = "fast-events.json"
    #: Names in the event document that its consumers expect.
    boost_field: str = "event_boost"
    host_events_reason: str = "host_events"


#: Items that are never scored, and changes too small to report.
ITEM_FILTERS = (ItemFilter("ignore-uptime", "*uptime*"), ItemFilter("ignore-localtime", "system.localtime"), ItemFilter("ignore-low-traffic", "net.if.*", "bps", 8000000))
ANOMALY_FILTERS = (
    AnomalyFilter("cpu-pct-noise", "*cpu.*", "%", 8),
    AnomalyFilter("mem-pct-noise", "*mem.*", "%", 8),
    AnomalyFilter("fs-size-pct-noise", "*vfs.fs.size*", "%", 3),
    AnomalyFilter("fs-size-bytes-noise", "*vfs.fs.size*", "B", 1000000000),
    AnomalyFilter("fs-inode-pct-noise", "*vfs.fs.inode*", "%", 3),
    AnomalyFilter("pused-pct-noise", "*.pused*", "%", 3),
    AnomalyFilter("webtest-time-noise", "web.test.time*", "s", 1),
    AnomalyFilter("net-traffic-noise", "net.if.*", "bps", 1000000),
    AnomalyFilter("proc-count-noise", "proc.num*", "", 5),
    AnomalyFilter("mysql-rate-noise", "mysql.com_*", "", 1),
    AnomalyFilter("unbound-histogram-noise", "unbound.histogram*", "", 100),
    AnomalyFilter("call-stats-noise", "call.stats.*", "", 10),
    AnomalyFilter("mssql-cache-object-noise", "mssql.cache_object*", "", 10),
    AnomalyFilter("pct-noise-catchall", "", "%", 3),
    AnomalyFilter("temp-noise", "", "°C", 5),
)


@dataclass(frozen=True)
class Source:
    """One data source with all settings that apply to it."""

    type: str = "csv"
    data_dir: str = ""
    url: str = ""
    options: dict = field(default_factory=dict)
    item_names: tuple[str, ...] = ()
    host_names: tuple[str, ...] = ()
    group_names: tuple[str, ...] = ()
    item_ids: tuple[int, ...] = ()
    max_items: int = 0
    batch_size: int = 100
    history_interval: int = 600
    history_retention: int = 18
    trends_retention: int = 14
    trends_range_to_sigma: float = 4.0
    anomaly_keep_secs: int = 259200
    staleness_secs: int = 3600
    detectors: Detectors = Detectors()
    ensemble: Ensemble = Ensemble()
    clustering: Clustering = Clustering()
    metric_categories: MetricCategories = MetricCategories()
    item_filters: tuple[ItemFilter, ...] = ITEM_FILTERS
    anomaly_filters: tuple[AnomalyFilter, ...] = ANOMALY_FILTERS
    fast_detect: FastDetect = FastDetect()

    @property
    def history_window(self) -> int:
        return self.history_retention * self.history_interval

    @property
    def recency_max_age(self) -> int:
        return self.metric_categories.recency.max_age_secs or self.history_window + 3600


@dataclass(frozen=True)
class Config:
    lock_dir: str = "/tmp/tidewatch/locks"
    warehouse: str = "tidewatch-tables"
    data_sources: dict[str, Source] = field(default_factory=dict)


def _build(kind: Any, value: Any, at: str, base: Any = None) -> Any:
    """`value` as `kind`; mappings are merged over `base`."""
    if is_dataclass(kind):
        if not isinstance(value, dict):
            raise ValueError(f"{at}: a mapping is expected")
        hints = get_type_hints(kind)
        if unknown := set(value) - set(hints):
            raise ValueError(f"{at}: unknown settings {sorted(unknown)}")
        start = base if base is not None else kind()
        return replace(start, **{k: _build(hints[k], v, f"{at}.{k}", getattr(start, k)) for k, v in value.items()})
    origin, args = get_origin(kind), get_args(kind)
    if origin is tuple:
        if not isinstance(value, (list, tuple)):
            raise ValueError(f"{at}: a list is expected")
        return tuple(_build(args[0], v, f"{at}[{i}]") for i, v in enumerate(value))
    if origin is Literal:
        if value not in args:
            raise ValueError(f"{at}: {value!r} is none of {args}")
        return value
    if origin is dict or kind is dict:
        return dict(value)
    if args and type(None) in args:
        return None if value is None else _build(next(a for a in args if a is not type(None)), value, at)
    if kind is float and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise ValueError(f"{at}: {value!r} is no {kind.__name__}")
    return value


def _render(text: str, values: dict[str, str]) -> str:
    """{{ NAME }} and {{ NAME | default('x') }} from the environment and secrets."""

    def put(m: re.Match) -> str:
        return values.get(m["name"], m["default"] or "")

    return re.sub(r"\{\{\s*(?P<name>\w+)\s*(?:\|\s*default\('(?P<default>[^']*)'\)\s*)?\}\}", put, text)


def load_config(path: str | None = None, secrets: dict[str, str] | None = None) -> Config:
    """The configuration of a YAML file over the defaults.

    Settings at the top level hold for every source; a source's own are merged over them, key by key at every depth.
    """
    if path is None:
        return Config()
    import yaml

    raw = yaml.safe_load(_render(Path(path).read_text(), {**os.environ, **(secrets or {})})) or {}
    shared = {f.name: raw.pop(f.name) for f in fields(Source) if f.name in raw and f.name != "type"}
    base = _build(Source, shared, "settings")
    sources = {name: _build(Source, spec or {}, f"data_sources.{name}", base) for name, spec in (raw.pop("data_sources", None) or {}).items()}
    known = {f.name for f in fields(Config)}
    return _build(Config, {k: v for k, v in raw.items() if k in known}, "settings", Config(data_sources=sources))
