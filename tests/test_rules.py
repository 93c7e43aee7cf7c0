import fnmatch
import random

from tidewatch.operators import rules

NAMES = ["net.if.in", "net.if.out", "system.cpu.util", "vfs.fs.size", "proc.num", "mysql.com", "web.test", "vm.memory"]


def corpus(seed, n_rules, n_keys):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6)))
    keys = [f"{rng.choice(NAMES)}.{word()}[{word()},{rng.randint(0, 99)}]" for _ in range(n_keys)] + ["", "x", None]
    shape = lambda: rng.choice(["{0}.{1}*", "{0}.{1}?[[]*", "*.{1}[[]{2}*", "*{1}{2}*", "{0}.[a-c]{1}*", "{0}.{1}[[]{2},[!0-4]?]"])
    globs = [(k, shape().format(rng.choice(NAMES), word(), word())) for k in range(n_rules)] + [(n_rules, "*[0-9]"), (n_rules + 1, "?"), (n_rules + 2, ""), (n_rules + 3, "x")]
    rng.shuffle(globs)
    return keys, globs


def test_rules_as_a_table_equal_the_chain(spark):
    keys, globs = corpus(1, 5000, 600)
    df = spark.createDataFrame([(k,) for k in keys * 2], "key string")
    want = {k: min((n for n, g in globs if fnmatch.fnmatchcase(k, g)), default=None) for k in keys if k is not None}
    got = {r.key: r.rule for r in rules.first_rule(df, rules.rule_table(spark, globs)).collect()}
    assert got == {k: n for k, n in want.items() if n is not None} and 100 < len(got) and len(set(got.values())) > 50


def test_few_rules_are_proposed(spark):
    """Five times the rules: far fewer pairs are judged than there are, and no more per rule."""
    judged = {}
    for n in (1000, 5000):
        keys, globs = corpus(2, n, 500)
        df = spark.createDataFrame([(k,) for k in keys], "key string")
        judged[n] = rules.proposals(df, rules.rule_table(spark, globs)).count()
        assert judged[n] < 0.05 * n * len(keys)
    assert judged[5000] < 6 * judged[1000]
