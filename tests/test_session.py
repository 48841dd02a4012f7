from crashlens.session import checkpoint_dir, staging_path


def test_checkpoint_dir_is_stable_and_staging_is_inside(spark):
    first = checkpoint_dir(spark)
    assert checkpoint_dir(spark) == first
    assert staging_path(spark, "x").startswith(first)


def test_apply_scale_conf_only_when_not_set(spark, tmp_out):
    import os

    from crashlens.session import apply_scale_conf
    path = os.path.join(tmp_out, "in.csv")
    with open(path, "w") as f:
        f.write("a\n1\n")
    other = spark.newSession()  # own SQL conf, same context
    for asked in ("200", "17"):  # a value that equals the default is still the user's
        other.conf.set("spark.sql.shuffle.partitions", asked)
        assert apply_scale_conf(other, [path]) == {}
        assert other.conf.get("spark.sql.shuffle.partitions") == asked
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
