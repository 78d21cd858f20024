"""The rename plan: collisions, related files, statuses, verification, history, undo, overrides."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import numbered, written

#: Extensions that make files belong together.
SIDECARS = (".xmp", ".aae", ".srt", ".thm", ".lrv")
LIVE_IMAGES = (".heic", ".jpg", ".jpeg")
LIVE_VIDEOS = (".mov", ".mp4")


def fold(name: Column) -> Column:
    return F.lower(name)


def with_suffix(name: Column, k: Column, separator: str = "_") -> Column:
    """The name with a two-digit counter before its extension; the name itself for k = 1."""
    dot = F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1
    stem = F.when(F.contains(name, F.lit(".")) & (dot > 0), F.left(name, dot.cast("int"))).otherwise(name)
    ext = F.substring(name, F.length(stem) + 1, F.length(name))
    return F.when(k == 1, name).otherwise(F.concat(stem, F.lit(separator), F.lpad(k.cast("string"), F.greatest(F.lit(2), F.length(k.cast("string"))), F.lit("0")), ext))


def resolve_collisions(plan: DataFrame, existing: DataFrame, folder: str = "dir", proposed: str = "proposed", source: str = "name", order: str = "ord") -> DataFrame:
    """Add target and collided: no two targets of a folder are equal ignoring case, nor equal to another existing name.

    The k-th claimant of a name takes its k-th free form (name, name_02, ...), where names that exist in
    the folder are taken except a claimant's own. Two families of names can meet only if one's proposal is a
    counted form of the other's, so what they share is the name without any counters: families that do meet,
    and those where a claimant already bears a form of its own name, are replayed in order with the names of
    that base only, one group each. Other names of the folder are not touched by it.
    """
    bases = lambda c: F.regexp_replace(fold(c), r"(?:_\d{2,})+(?=\.[^.]*$|$)", "")
    rows = plan.withColumns({"_fold": fold(F.col(proposed)), "_base": bases(F.col(proposed))})
    family = Window.partitionBy(folder, "_fold").orderBy(order)
    rows = rows.withColumn("_k", F.row_number().over(family))
    # Only existing names that some family could want: the proposal itself or a counted form of it.
    bare = lambda c: F.regexp_replace(fold(c), r"_\d{2,}(?=\.[^.]*$|$)", "")
    held = existing.select(F.col(folder), bare(F.col(source)).alias("_fold"), fold(F.col(source)).alias("_held"))
    held = held.unionByName(existing.select(F.col(folder), fold(F.col(source)).alias("_fold"), fold(F.col(source)).alias("_held"))).distinct()
    # Taken counters of a family in order; the k-th free number is k and as many more as taken ones stand before it.
    counter = F.when(F.col("_held") == F.col("_fold"), F.lit(1)).otherwise(F.regexp_extract("_held", r"_(\d{2,9})(?=\.[^.]*$|$)", 1).try_cast("int"))
    held = held.withColumn("_at", counter).where((F.col("_at") >= 1) & (with_suffix(F.col("_fold"), F.col("_at")) == F.col("_held")))
    taken = held.groupBy(folder, "_fold").agg(F.sort_array(F.collect_set("_at")).alias("_taken"), F.collect_set("_held").alias("_names"))
    rows = rows.join(taken, [folder, "_fold"], "left").withColumn("_taken", F.coalesce("_taken", F.array().cast("array<int>")))
    own = fold(F.col(source))
    before = F.size(F.filter("_taken", lambda t, i: t - i <= F.col("_k")))
    # Written down once, as the questions below and both ways of solving read it.
    rows = written(rows.withColumn("target", with_suffix(F.col(proposed), F.col("_k") + before)))
    # Where families meet, or a row's own name changes what is free for the next, their base is replayed in order.
    base = [folder, "_base"]
    made = rows.groupBy(*base, F.lower("target").alias("_t")).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(*base)
    odd = rows.where(F.array_contains(F.col("_names"), own)).select(*base)
    replay = written(made.unionByName(odd).distinct())
    easy = rows.join(replay, base, "left_anti").select(*plan.columns, "target")
    hard = rows.join(replay, base, "left_semi").select(*plan.columns, "_base")
    names = existing.select(F.col(folder), bases(F.col(source)).alias("_base"), fold(F.col(source)).alias("_held")).join(replay, base, "left_semi")
    names = names.select(F.col(folder).alias("_at"), F.col("_base").alias("_of"), "_held").distinct()
    columns = [*plan.columns, "target"]
    schema = ", ".join(f"`{n}` {t}" for n, t in [*plan.dtypes, ("target", "string")])

    def in_turn(group: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        blocked, taken, free, targets = set(names["_held"]), set(), {}, []

        def form(name: str, k: int) -> str:
            if k == 1:
                return name
            stem, dot, ext = name.rpartition(".")
            return f"{stem}_{k:02d}.{ext}" if dot and stem else f"{name}_{k:02d}"

        group = group.sort_values(order)
        for name, own in zip(group[proposed], group[source]):
            low, own = name.lower(), own.lower()
            k = free.get(low, 1)  # what was not free once never will be
            while form(low, k) in blocked:
                k += 1
            free[low] = k
            digits = own.rpartition(".")[0].rpartition("_")[2] if "." in own else own.rpartition("_")[2]
            counted = 1 if own == low else int(digits) if digits.isdigit() and len(digits) < 10 else 0
            if 0 < counted < k and form(low, counted) == own and own not in taken:
                k = counted  # its own name stands in nobody's way but others'
            targets.append(form(name, k))
            taken.add(form(low, k))
            blocked.add(form(low, k))
        return group.assign(target=targets)[columns]

    replayed = hard.groupBy(*base).cogroup(names.groupBy("_at", "_of")).applyInPandas(in_turn, schema)
    solved = easy.unionByName(replayed)
    return solved.withColumn("collided", F.col("target") != F.col(proposed))


def related(files: DataFrame, folder: str = "dir", stem: str = "stem", ext: str = "ext") -> DataFrame:
    """Add related: SIDECAR_DETECTED or LIVE_PHOTO_PAIR_DETECTED for files that share folder and stem, else null."""
    together = Window.partitionBy(folder, F.lower(stem))
    told = files.withColumn("_exts", F.collect_set(F.lower(ext)).over(together))
    has = lambda xs: F.arrays_overlap("_exts", F.array(*map(F.lit, xs)))
    return told.withColumn(
        "related", F.when(has(SIDECARS), "SIDECAR_DETECTED").when(has(LIVE_IMAGES) & has(LIVE_VIDEOS), "LIVE_PHOTO_PAIR_DETECTED")
    ).drop("_exts")


def plan_status(plan: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Add status and selected from source, target, related, good_name, confidence and renamed_on."""
    status = (
        F.when(F.col("target").isNull(), "NO_NAME_PROPOSED")
        .when(F.col("target") == F.col("name"), "NAME_UNCHANGED")
        .when(F.col("related").isNotNull(), F.col("related"))
        .when(F.col("good_name"), "GOOD_NAME_KEPT")
        .when(F.col("confidence") < threshold, "SKIPPED_LOW_CONFIDENCE")
        .when(F.col("renamed_on").isNotNull(), "ALREADY_RENAMED")
        .otherwise("OK")
    )
    return plan.withColumn("status", status).withColumn("selected", F.col("status") == "OK")


def verify(plan: DataFrame, now: DataFrame, key: str = "path") -> DataFrame:
    """Add verified: missing, size_changed, time_changed, content_changed or ok, against the inventory as it is now."""
    seen = now.select(key, F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("sha256").alias("_sha"))
    joined = plan.join(seen, key, "left")
    gap = F.abs(F.unix_micros(F.col("_mtime").cast("timestamp")) - F.unix_micros(F.col("mtime").cast("timestamp")))
    state = (
        F.when(F.col("_size").isNull(), "missing")
        .when(F.col("_size") != F.col("size"), "size_changed")
        .when(gap > 1_000_000, "time_changed")
        .when(F.col("_sha") != F.col("sha256"), "content_changed")
        .otherwise("ok")
    )
    return joined.withColumn("verified", state).drop("_size", "_mtime", "_sha")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of one inventory that the other lacks, with `side`; duplicates count."""
    gone, new = before.exceptAll(after), after.exceptAll(before)
    return gone.withColumn("side", F.lit("removed")).unionByName(new.withColumn("side", F.lit("added")))


def history(records: DataFrame, session: str, stamp: str, keep: int = 200) -> DataFrame:
    """(key_kind, key, stamp) of the newest `keep` sessions: the newest stamp for each hash and each folded name."""
    newest = records.select(session).distinct().orderBy(F.col(session).desc()).limit(keep)
    recent = records.join(F.broadcast(newest), session)  # `keep` rows
    keys = F.array(F.struct(F.lit("hash").alias("key_kind"), F.col("sha256").alias("key")), F.struct(F.lit("name").alias("key_kind"), F.lower("new_name").alias("key")))
    return recent.select(session, stamp, F.inline(keys)).groupBy("key_kind", "key").agg(F.max_by(stamp, session).alias("stamp"))


def renamed_on(files: DataFrame, known: DataFrame) -> DataFrame:
    """Add renamed_on: the stamp by content hash, otherwise by folded name."""
    hashes = known.where("key_kind = 'hash'").select(F.col("key").alias("sha256"), F.col("stamp").alias("_by_hash"))
    names = known.where("key_kind = 'name'").select(F.col("key").alias("_fold"), F.col("stamp").alias("_by_name"))
    told = files.withColumn("_fold", F.lower("name")).join(hashes, "sha256", "left").join(names, "_fold", "left")
    return told.withColumn("renamed_on", F.coalesce("_by_hash", "_by_name")).drop("_fold", "_by_hash", "_by_name")


def packed(digest: Column) -> Column:
    """Bytes that are equal only for equal texts: the 32 of a digest of 64 small hexadecimal digits, more of any other text."""
    return F.when(digest.rlike(r"^[0-9a-f]{64}\z"), F.unhex(digest)).otherwise(F.concat(digest, F.lit(" " * 33)).cast("binary"))


def undo_plan(records: DataFrame, now: DataFrame) -> DataFrame:
    """One row for each record, in reverse order of seq (an integer): ok, or why it can't be undone.

    A path that `now` has more than once counts once, with the first of its digests in the order of `packed`.
    `turn` numbers a session's records in blocks of 65,536 seqs, so that no task holds a whole session.

    What a record's own columns tell is told before it moves, and contents are compared where they meet, so that digests
    move once, packed. As no path matches twice, the records themselves are counted and the joins made once.
    """
    parent = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    ext = lambda c: F.lower(F.regexp_extract(c, r"(\.[^./]*)$", 1))
    once = Window.partitionBy("path")
    first = lambda by: F.lag(F.lit(1)).over(once.orderBy(F.col(by).asc_nulls_last())).isNull()
    held = now.select("path", packed(F.col("sha256")).alias("_sha")).withColumn("_first", first("_sha")).where("_first")
    taken = now.select("path").withColumn("_first", first("path")).where("_first")
    current = held.select(F.col("path").alias("new_path"), "_sha")
    original = taken.select(F.col("path").alias("old_path"), F.lit(True).alias("_busy"))
    own = records.withColumns(
        {
            "_own": packed(F.col("sha256")),
            "_moved": F.lower("old_path") != F.lower("new_path"),
            "_folder": parent(F.col("old_path")) != parent(F.col("new_path")),
            "_ext": ext(F.col("old_path")) != ext(F.col("new_path")),
        }
    )
    met = own.join(current, "new_path", "left").withColumn("_found", F.when(F.col("_sha").isNull(), "missing").when(F.col("_sha") != F.col("_own"), "changed")).drop("_own", "_sha")
    state = (
        F.when(F.col("_found").isNotNull(), F.col("_found"))
        .when(F.col("_busy") & F.col("_moved"), "occupied")
        .when(F.col("_folder"), "other_folder")
        .when(F.col("_ext"), "other_extension")
        .otherwise("ok")
    )
    told = met.join(original, "old_path", "left").withColumn("undo", state).drop("_found", "_busy", "_moved", "_folder", "_ext")
    block = F.coalesce(-F.shiftright(F.col("seq").cast("long"), 16), F.lit((1 << 63) - 1))
    return numbered(told, "session", [F.col("seq").desc()], "turn", block, records)


def incomplete_sessions(records: DataFrame) -> DataFrame:
    """Sessions with a record and without a footer that says completed."""
    per = records.groupBy("session").agg(
        F.count_if(F.col("type") == "record").alias("n_records"), F.coalesce(F.bool_or((F.col("type") == "footer") & F.col("completed")), F.lit(False)).alias("done")
    )
    return per.where("n_records >= 1 AND NOT done").select("session", "n_records")


def override(plan: DataFrame, chosen: DataFrame, folder: str = "dir") -> DataFrame:
    """Apply chosen names (folder, name, chosen) to a plan, each to its own file.

    Refused where the extension differs, or where the name is taken in the folder: by another row's target, or by
    another choice (the first name in order keeps it).
    """
    ext = lambda c: F.lower(F.regexp_extract(c, r"(\.[^.]*)$", 1))
    wanted = chosen.select(folder, "name", "chosen", F.lower("chosen").alias("_fold"))
    wanted = wanted.withColumn("_first", F.min("name").over(Window.partitionBy(folder, "_fold")) == F.col("name"))
    others = plan.select(F.col(folder), F.lower("target").alias("_fold"), F.col("name").alias("_other"))
    taken = wanted.join(others, [folder, "_fold"]).where("_other <> name").select(folder, "name").distinct().withColumn("_taken", F.lit(True))
    told = plan.join(wanted.drop("_fold"), [folder, "name"], "left").join(taken, [folder, "name"], "left")
    result = (
        F.when(F.col("chosen").isNull(), "unchanged").when(ext(F.col("chosen")) != ext(F.col("name")), "extension")
        .when(F.col("_taken") | ~F.col("_first"), "taken").otherwise("manual")
    )
    told = told.withColumn("override", result).withColumn("target", F.when(F.col("override") == "manual", F.col("chosen")).otherwise(F.col("target")))
    return told.select(*plan.columns, "override")


def upsert(plan: DataFrame, fresh: DataFrame, folder: str = "dir", key: str = "name", order: Column | None = None) -> DataFrame:
    """The plan with the rows of `fresh` in place of its own (by folder and key); rows that the plan lacks are left out.

    Rows are replaced in `order` (over the plan's columns; by key if there is none). A fresh row whose target another row
    of the folder has at that moment is not selected and says so: a row that stays, one that was replaced before it, by
    its new target, or one that is replaced later, by its old one. Add updated.
    """
    turn = F.struct((order if order is not None else F.col(key)).alias("o"), F.col(key).alias("k"))
    rows = plan.select(*plan.columns, turn.alias("_turn"))
    hit = fresh.select(*plan.columns).join(rows.select(folder, key, "_turn"), [folder, key])
    gone = hit.select(folder, key, F.lit(True).alias("_gone"))
    old = rows.join(gone, [folder, key], "left").select(folder, F.lower("target").alias("_fold"), "_turn", F.coalesce("_gone", F.lit(False)).alias("_gone"), F.lit(False).alias("_new"))
    claims = old.unionByName(hit.select(folder, F.lower("target").alias("_fold"), "_turn", F.lit(True).alias("_gone"), F.lit(True).alias("_new")))
    held = claims.groupBy(folder, "_fold").agg(
        F.count_if(~F.col("_gone")).alias("_stay"), F.min(F.when(F.col("_new"), F.col("_turn"))).alias("_first"), F.max(F.when(F.col("_gone") & ~F.col("_new"), F.col("_turn"))).alias("_last")
    )
    told = hit.withColumn("_fold", F.lower("target")).join(held, [folder, "_fold"])
    taken = F.coalesce((F.col("_stay") > 0) | (F.col("_first") < F.col("_turn")) | (F.col("_last") > F.col("_turn")), F.lit(False))
    told = told.withColumn("_taken", taken).withColumns(
        {
            "selected": F.col("selected") & ~F.col("_taken"),
            "status": F.when(F.col("_taken"), "NAME_COLLISION_RESOLVED").otherwise(F.col("status")),
        }
    )
    kept = plan.join(gone, [folder, key], "left_anti").select(*plan.columns, F.lit(False).alias("updated"))
    return kept.unionByName(told.select(*plan.columns, F.lit(True).alias("updated")))


def counters(plan: DataFrame) -> DataFrame:
    """Rows of a plan by status, and how many of them are selected."""
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("n_selected"))


def selected_rows(plan: DataFrame, source: str = "name") -> DataFrame:
    """The rows that a rename would act on: selected, and with another name than before."""
    return plan.where(F.col("selected") & (F.col(source) != F.col("target")))


def metadata_preserved(size_before: Column, size_after: Column, time_before: Column, time_after: Column) -> Column:
    """Equal sizes and times within a second; what is unknown counts as preserved."""
    same_size = F.coalesce(size_before == size_after, F.lit(True))
    near = F.abs(F.unix_micros(time_before) - F.unix_micros(time_after)) <= 1_000_000
    return same_size & F.coalesce(near, F.lit(True))


def merge_histories(sources: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key of several histories: that of the source with the highest `order`."""
    best = F.max_by(F.struct(*[c for c in sources.columns if c != key]), F.col(order)).alias("_best")
    return sources.groupBy(key).agg(best).select(key, "_best.*").select(*sources.columns)


def apply_order(plan: DataFrame, session: str, kind: str, path: str) -> DataFrame:
    """Add turn: files first, then folders from the deepest up, so that no path changes before it is used."""
    depth = F.size(F.split(path, "/"))
    order = [(F.col(kind) == "folder").cast("int"), F.when(F.col(kind) == "folder", -depth).otherwise(0), F.col(path)]
    return numbered(plan, session, order, "turn")


def merge_as_document(chosen: DataFrame, group: str, base: str, stem: str, ext: str, order: str) -> DataFrame:
    """Number chosen rows as the pages of one document, by the number in their names: base_стр_01.ext."""
    number = F.coalesce(F.regexp_extract(stem, r"(\d+)\D*$", 1).try_cast("long"), F.lit(1 << 40))
    place = F.row_number().over(Window.partitionBy(group).orderBy(number, order))
    every = F.count(F.lit(1)).over(Window.partitionBy(group))
    told = chosen.withColumns({"page": place, "_n": every})
    label = F.lpad(F.col("page").cast("string"), F.length(F.col("_n").cast("string")), F.lit("0"))
    return told.withColumn("target", F.concat(F.col(base), F.lit("_стр_"), label, F.col(ext))).drop("_n")
