"""Replicated command logs: state, commitment, elections, conflicts and safety checks."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_commands(log: DataFrame, command: str = "command") -> DataFrame:
    """Adds op (upper case), name and value of JSON commands; unreadable commands give nulls."""
    c = F.from_json(command, "Operation string, Name string, Value string", {"mode": "PERMISSIVE"})
    return log.withColumn("_c", c).withColumn("op", F.upper("_c.Operation")).withColumn("name", F.col("_c.Name")).withColumn("value", F.col("_c.Value")).drop("_c")


def state(log: DataFrame, upto: int | None = None) -> DataFrame:
    """(name, value, index) after applying SET and DELETE in index order; other operations do nothing.

    The last command of a name decides: one combining aggregate, no order of the whole log.
    """
    live = log.where(F.col("op").isin("SET", "DELETE") & F.col("name").isNotNull())
    if upto is not None:
        live = live.where(F.col("index") <= upto)
    last = live.groupBy("name").agg(F.max_by(F.struct("op", "value", "index"), "index").alias("s"))
    return last.where(F.col("s.op") == "SET").select("name", F.col("s.value").alias("value"), F.col("s.index").alias("index"))


def read_setting(settings: DataFrame, name: str, commit: int) -> DataFrame:
    """The row of one setting with how far behind the commit index its last write lies."""
    if not name.strip():
        raise ValueError("a name is needed")
    return settings.where(F.col("name") == name).withColumn("behind", F.lit(commit) - F.col("index"))


def commit_index(log: DataFrame, matches: DataFrame, term: int) -> DataFrame:
    """(leader, commit_index): the highest index of the current term that a majority holds.

    ``matches`` (leader, server, match_index) includes the leader itself; one server is its own
    majority.  ``log`` (leader, index, term).
    """
    m = matches.groupBy("leader").agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("m"))
    m = m.select("leader", F.element_at("m", F.floor(F.size("m") / 2).cast("int") + 1).alias("held"))
    own = log.where(F.col("term") == term).join(m, "leader").where(F.col("index") <= F.col("held"))
    best = own.groupBy("leader").agg(F.max("index").alias("commit_index"))
    return m.join(best, "leader", "left").select("leader", F.coalesce("commit_index", F.lit(0)).cast("long").alias("commit_index"))


def up_to_date(term, index, own_term, own_index):
    """Whether a candidate's log is at least as new: (term, index) compared in that order."""
    return (term > own_term) | ((term == own_term) & (index >= own_index))


def grants(requests: DataFrame) -> DataFrame:
    """The vote of each (voter, term): the first request that is valid, by arrival ``seq``.

    ``requests``: voter, term, candidate, seq, voter_term, last_term, last_index, own_term, own_index.
    """
    ok = requests.where((F.col("term") >= F.col("voter_term")) & up_to_date(F.col("last_term"), F.col("last_index"), F.col("own_term"), F.col("own_index")))
    return ok.groupBy("voter", "term").agg(F.min_by("candidate", "seq").alias("candidate"))


def elected(votes: DataFrame, servers: int) -> DataFrame:
    """(term, candidate, votes) with more than half of ``servers`` distinct voters."""
    n = votes.groupBy("term", "candidate").agg(F.countDistinct("voter").alias("votes"))
    return n.where(F.col("votes") > servers // 2)


def append_entries(follower: DataFrame, entries: DataFrame) -> DataFrame:
    """(server, index, term, command) after a follower took ``entries`` of its leader.

    Everything from the first index on whose terms differ goes; what is missing comes.  Both have
    server, index, term, command.
    """
    both = follower.select("server", "index", F.col("term").alias("t1")).join(entries.select("server", "index", F.col("term").alias("t2")), ["server", "index"])
    cut = both.where("t1 <> t2").groupBy("server").agg(F.min("index").alias("cut"))
    kept = follower.join(cut, "server", "left").where(F.col("cut").isNull() | (F.col("index") < F.col("cut"))).drop("cut")
    new = entries.join(kept.select("server", "index"), ["server", "index"], "left_anti")
    return kept.select("server", "index", "term", "command").unionByName(new.select("server", "index", "term", "command"))


def consistent(follower: DataFrame, probes: DataFrame) -> DataFrame:
    """Adds ``ok`` to probes (server, prev_index, prev_term): index 0, or an entry of that very term."""
    f = follower.select("server", F.col("index").alias("prev_index"), F.col("term").alias("_t"))
    return probes.join(f, ["server", "prev_index"], "left").withColumn("ok", (F.col("prev_index") == 0) | F.coalesce(F.col("_t") == F.col("prev_term"), F.lit(False))).drop("_t")


def to_apply(log: DataFrame, last_applied: int, commit: int) -> DataFrame:
    """Entries that are committed and not applied yet; callers order by index."""
    return log.where((F.col("index") > last_applied) & (F.col("index") <= commit))


def next_index(after: DataFrame) -> DataFrame:
    """nextIndex after replies (follower, next_index, success, sent): one back on a refusal, 1 at least."""
    return after.withColumn("next_index", F.when(F.col("success"), F.col("next_index") + F.col("sent")).otherwise(F.greatest(F.col("next_index") - 1, F.lit(1))))


def two_leaders(elections: DataFrame) -> DataFrame:
    """Terms with more than one leader: none, if elections are safe."""
    return elections.groupBy("term").agg(F.countDistinct("candidate").alias("leaders")).where("leaders > 1")


def mismatched(log: DataFrame) -> DataFrame:
    """(index, term) at which servers hold different commands: none, if logs match."""
    return log.groupBy("index", "term").agg(F.countDistinct("command").alias("commands")).where("commands > 1")


def diverged_state(log: DataFrame, applied: DataFrame) -> DataFrame:
    """Indexes applied with different commands on different servers (applied: server, index)."""
    a = log.join(applied, ["server", "index"])
    return a.groupBy("index").agg(F.countDistinct("command").alias("commands")).where("commands > 1")


def incomplete_leaders(committed: DataFrame, leader_log: DataFrame, few: int = 100_000) -> DataFrame:
    """Committed (index, term) that a later leader's log (leader, leader_term, index, term) lacks.

    Leaders are first compared by counts: what is due by the committed terms (a row for each term), and what
    they hold of it (an equi-join).  Only leaders that lack something meet the committed entries.
    """
    of_term = committed.groupBy("term").agg(F.count("*").alias("n"))
    leaders = leader_log.select("leader", "leader_term").distinct()
    due = leaders.join(of_term, F.col("leader_term") > F.col("term")).groupBy("leader", "leader_term").agg(F.sum("n").alias("due"))
    own = leader_log.select("leader", "leader_term", "index", "term").where("leader_term > term").distinct()
    held = own.join(committed.select("index", "term").distinct(), ["index", "term"]).groupBy("leader", "leader_term").agg(F.count("*").alias("held"))
    short = due.join(held, ["leader", "leader_term"], "left").where(F.coalesce("held", F.lit(0)) < F.col("due")).select("leader", "leader_term")
    short = F.broadcast(short) if short.count() <= few else short
    lacking = committed.join(short, F.col("leader_term") > F.col("term"))
    return lacking.join(leader_log.select("leader", "index", "term"), ["leader", "index", "term"], "left_anti")


def commit_after(appends: DataFrame) -> DataFrame:
    """Adds ``commit_index`` after append requests (commit, leader_commit, prev_index, last_index): the smaller of
    the leader's commit and the last new index (null without entries: the previous index), never backwards."""
    last = F.coalesce("last_index", "prev_index")
    return appends.withColumn("commit_index", F.when(F.col("leader_commit") > F.col("commit"), F.least("leader_commit", last)).otherwise(F.col("commit")))


def adopt_term(messages: DataFrame) -> DataFrame:
    """Adds new_term, accepted and steps_down to messages (own_term, term, role): an older term is refused,
    a newer one is taken over and makes a follower."""
    newer = F.col("term") > F.col("own_term")
    return messages.withColumn("new_term", F.greatest("own_term", "term")).withColumn("accepted", F.col("term") >= F.col("own_term")).withColumn("steps_down", newer & (F.col("role") != "follower"))


def submit(log: DataFrame, requests: DataFrame) -> DataFrame:
    """(server, index, term, command) that leaders add to ``log`` for ``requests`` (server, role, term, seq, command).

    Only leaders take commands; each server numbers its own on from the end of its log, by ``seq``.
    """
    ends = log.groupBy("server").agg(F.max("index").alias("end"))
    taken = requests.where(F.col("role") == "leader").join(ends, "server", "left")
    place = F.row_number().over(Window.partitionBy("server").orderBy("seq"))
    return taken.select("server", (F.coalesce("end", F.lit(0)) + place).cast("long").alias("index"), "term", "command")


def contains(settings: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``present`` to rows of ``names`` (name): whether the settings hold that name now."""
    held = settings.select("name", F.lit(True).alias("_held"))
    return names.join(held, "name", "left").withColumn("present", F.coalesce("_held", F.lit(False))).drop("_held")
