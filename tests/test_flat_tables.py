from __spark_entry__ import queries


def test_tables_of_every_node_are_queries():
    assert {"p3_change_of_files", "p3_changes", "p3_events"} <= set(queries())
