"""In what order files can be renamed so that none is written over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

PARKED = ".parked-"


def _jumped(edges: DataFrame) -> DataFrame:
    """old, next, hops, least, last of old, next (the rename that must come before, null if none), last (the name that a chain's end takes).

    Pointers double: after k rounds each rename knows the 2^k before it. A chain's have no next in the end and know their ``hops`` to it; those
    of a cycle keep one, and ``least`` is the cycle's least name. Rounds go on while any of this changes, so their number is the logarithm of
    the longest chain or cycle. A name is joined once a round, whatever the shape of the graph.
    """
    state = written(edges.select("old", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.col("old").alias("least"), "last"), "renames")
    open_before = None
    while True:
        to = state.select(F.col("old").alias("_old"), F.col("next").alias("_next"), F.col("hops").alias("_hops"), F.col("least").alias("_least"), F.col("last").alias("_last"))
        met = state.join(to, F.col("next") == F.col("_old"), "left")
        state = written(
            met.select(
                "old",
                F.col("_next").alias("next"),
                (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
                F.least("least", "_least").alias("least"),
                F.coalesce("_last", "last").alias("last"),
                (F.least("least", "_least") != F.col("least")).alias("_new"),
            ),
            "renames",
        )
        open_, new = state.agg(F.count("next"), F.count_if("_new")).first()
        if not open_ or (open_ == open_before and not new):
            return state.drop("_new")
        open_before = open_


def rename_steps(wanted: DataFrame, names: DataFrame, *, name: str = "name") -> DataFrame:
    """action, step, old, new: what becomes of each wanted rename (old, new), and in what order files are to be renamed.

    - ``rename``: by ``step`` from the least on; those of one step don't touch each other. A name that is itself to be renamed is so first.
    - ``park``, step 0: a cycle of renames is opened by moving the file of its least name to a name of its own; that file's rename starts from there, last.
    - ``missing``: no file has the old name. ``conflict``: two files are to get one name, or one file two names.
    - ``taken``: the new name is that of a file that stays, or of one that can't move for this reason (or a cycle's parking name is).

    Renames to the same name and null names are left out, repeated ones count once. All but ``rename`` and ``park`` have a null step and change nothing.
    """
    there = written(names.select(F.col(name).alias("_name")).where("_name is not null").distinct(), "rename-names")
    own = wanted.select("old", "new").where("old <> new").distinct()
    found = own.join(there.select(F.col("_name").alias("old"), F.lit(True).alias("_there")), "old", "left")
    missing = found.where("_there is null")
    present = written(found.where("_there").select("old", "new"), "rename-present")
    twice = lambda c: present.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(c, F.lit(True).alias(f"_{c}"))
    marked = written(present.join(twice("old"), "old", "left").join(twice("new"), "new", "left").select("old", "new", (F.col("_old").isNotNull() | F.col("_new").isNotNull()).alias("_clash")), "rename-marked")
    clear = marked.where(~F.col("_clash")).select("old", "new")
    edges = clear.join(clear.select(F.col("old").alias("next")), F.col("new") == F.col("next"), "left").select("old", "next", F.col("new").alias("last"))
    jumped = _jumped(edges)

    chains = jumped.where("next is null").join(there.select("_name", F.lit(True).alias("_taken")), F.col("last") == F.col("_name"), "left").select("old", (F.col("hops") + 1).alias("step"), F.coalesce("_taken", F.lit(False)).alias("_taken"))
    rings = written(jumped.where("next is not null").select("old", "least"), "rename-rings")
    # A ring without its least name's rename is a chain to that name.
    opened = rings.where("old <> least").join(clear, "old").select("old", F.when(F.col("new") != F.col("least"), F.col("new")).alias("next"), F.col("new").alias("last"))
    within = _jumped(opened).select("old", (F.col("hops") + 1).alias("step"))
    sizes = rings.groupBy("least").agg(F.count(F.lit(1)).alias("_size"))
    parking = sizes.join(there.select(F.col("_name").alias("_parked"), F.lit(True).alias("_taken")), F.concat(F.lit(PARKED), F.col("least")) == F.col("_parked"), "left").select("least", "_size", F.coalesce("_taken", F.lit(False)).alias("_taken"))
    turned = rings.join(parking, "least").join(within, "old", "left").select("old", F.coalesce("step", "_size").alias("step"), "_taken", (F.col("old") == F.col("least")).alias("_first"))

    steps = chains.withColumn("_first", F.lit(False)).unionByName(turned).join(clear, "old")
    moved = steps.select(F.when(F.col("_taken"), "taken").otherwise("rename").alias("action"), F.when(~F.col("_taken"), F.col("step")).alias("step"), F.when(F.col("_first") & ~F.col("_taken"), F.concat(F.lit(PARKED), F.col("old"))).otherwise(F.col("old")).alias("old"), "new")
    parked = steps.where("_first and not _taken").select(F.lit("park").alias("action"), F.lit(0).cast("long").alias("step"), "old", F.concat(F.lit(PARKED), F.col("old")).alias("new"))
    left = lambda rows, action: rows.select(F.lit(action).alias("action"), F.lit(None).cast("long").alias("step"), "old", "new")
    return moved.unionByName(parked).unionByName(left(missing, "missing")).unionByName(left(marked.where("_clash"), "conflict"))
