"""python -m tidewatch detect|fast|stats|health [--config FILE] [--endep EPOCH] [--wait SECS] [--init]"""

from __future__ import annotations

import argparse
import contextlib
import logging
import sys
import time

from .config import load_config
from .plans.cycle import run_detection, run_fast, update_statistics
from .plans.lease import hold
from .plans.lock import EX_TEMPFAIL, Held, single_instance
from .sources import get_data_source
from .sources.stores import Stores

log = logging.getLogger("tidewatch")


def health(spark, source, stores: Stores) -> dict[str, int]:
    """Rows of every table, after a scratch table was written, read and dropped and the source was reached."""
    from . import schemas
    from .sources.stores import Table

    scratch = Table(spark, f"{stores.history.path}-health", schemas.UPDATES, [])
    scratch.create()
    assert scratch.read().count() == 0 and source.check_conn()
    scratch.drop()
    return {t.path.rsplit("/", 1)[-1]: t.read().count() for t in stores.all()}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=("detect", "fast", "stats", "health"))
    p.add_argument("--config")
    p.add_argument("--endep", type=int, default=0)
    p.add_argument("--wait", type=float, default=0)
    p.add_argument("--init", action="store_true", help="drop and recreate all tables first")
    args = p.parse_args(argv)
    cfg, endep = load_config(args.config), args.endep or int(time.time())
    try:
        with single_instance(args.command, cfg.lock_dir, args.wait), contextlib.ExitStack() as opened:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("tidewatch").config("spark.sql.session.timeZone", "UTC").getOrCreate()
            failed = 0
            for name, ds in cfg.data_sources.items():
                try:
                    held = opened.enter_context(hold(spark, f"{cfg.warehouse}/leases", f"{name}-{args.command}"))
                    source, stores = get_data_source(spark, ds), Stores(spark, cfg.warehouse, name).guarded(held.check)
                    stores.init() if args.init else stores.create()
                    if args.command == "detect":
                        log.info("%s: %d new anomalies", name, run_detection(spark, source, stores, ds, endep).count())
                    elif args.command == "stats":
                        update_statistics(spark, source, stores, ds, endep)
                    elif args.command == "fast":
                        if ds.fast_detect.enabled:
                            run_fast(spark, source, stores, ds, endep, name, len(cfg.data_sources))
                    else:
                        print(name, health(spark, source, stores))
                except Held:
                    raise
                except Exception:  # one failing source doesn't stop the others
                    log.exception("%s failed", name)
                    failed = 1
            return failed
    except Held as e:
        log.warning("%s", e)
        return EX_TEMPFAIL


if __name__ == "__main__":
    sys.exit(main())
