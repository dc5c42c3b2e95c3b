"""Existence, listing and deletion of paths, on whatever file system a path names."""


def _at(spark, path):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark, path):
    system, place = _at(spark, path)
    return system.exists(place)


def children(spark, path):
    """Full paths of what lies directly in a folder, sorted; nothing if there is no folder."""
    system, place = _at(spark, path)
    if not system.exists(place):
        return []
    return sorted(status.getPath().toString() for status in system.listStatus(place))


def delete(spark, path):
    system, place = _at(spark, path)
    system.delete(place, True)


def touch(spark, path):
    """Make sure that an empty file exists."""
    system, place = _at(spark, path)
    system.create(place, True).close()
