from concurrent.futures import ThreadPoolExecutor

import pytest

from tidewatch import schemas
from tidewatch.plans.lease import Lease, Lost, hold
from tidewatch.plans.lock import Held
from tidewatch.sources.stores import Stores


def test_who_lost_the_lease_cannot_write(spark, tmp_path):
    now = [1e12]  # beyond every file's time
    one, two = (Lease(spark, f"file://{tmp_path}/l", "detect", 10, lambda: now[0]) for _ in range(2))
    one.acquire()
    with pytest.raises(Held):
        two.acquire()
    row = lambda v: spark.createDataFrame([(1, 2)] * v, schemas.UPDATES)
    mine, theirs = (Stores(spark, f"file://{tmp_path}/wh", "ds").guarded(x.check) for x in (one, two))
    mine.create()
    mine.trends_updates.replace(row(1))
    now[0] += 9
    one.renew()
    now[0] += 9
    with pytest.raises(Held):
        two.acquire()
    now[0] += 2
    two.acquire()
    assert (one.number, two.number) == (1, 2)
    for write in (lambda: mine.trends_updates.replace(row(5)), lambda: mine.history.upsert(spark.createDataFrame([(1, 5, 1.0)], schemas.HISTORY)), mine.init, one.renew):
        with pytest.raises(Lost):
            write()
    theirs.trends_updates.replace(row(2))
    assert mine.trends_updates.read().count() == 2 and mine.history.read().count() == 0
    two.release()
    one.acquire()
    assert one.number == 3


def test_losing_it_during_a_write_changes_nothing(spark, tmp_path):
    stores, calls = Stores(spark, f"file://{tmp_path}/wh", "ds"), []
    stores.create()

    def guard():
        calls.append(1)
        if len(calls) == 2:
            raise Lost("gone")

    with pytest.raises(Lost):
        stores.guarded(guard).history_updates.replace(spark.createDataFrame([(1, 2)], schemas.UPDATES))
    assert stores.history_updates.read().count() == 0 and sorted(p.name for p in (tmp_path / "wh/ds/history_updates").iterdir()) == ["v1"]


def test_one_of_many_gets_it(spark, tmp_path):
    def attempt(_):
        lease = Lease(spark, f"file://{tmp_path}/l", "fast", 60)
        try:
            lease.acquire()
            return 1
        except Held:
            return 0

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(attempt, range(8))) == 1


def test_it_is_renewed_and_released(spark, tmp_path):
    import time

    with hold(spark, f"file://{tmp_path}/l", "stats", 0.6) as lease:
        time.sleep(1.5)
        with pytest.raises(Held):
            Lease(spark, f"file://{tmp_path}/l", "stats", 0.6).acquire()
        lease.check()
    with hold(spark, f"file://{tmp_path}/l", "stats", 60) as again:
        assert again.number == lease.number + 1
