from foliotab.operators import topology


def test_components_of_one_object(spark, monkeypatch):
    fields = [("Name", "b"), ("Component_2_Object_Type", "Fan"), ("Component_2_Name", "f"), ("Component_2_Inlet_Node_Name", "i"), ("Component_2_Outlet_Node_Name", "o")]
    fields += [("Component_10_Object_Type", "Coil"), ("Component_10_Name", "c"), ("Component_x_Name", "no"), ("Component_3", "no"), ("Component_11_Object_Type", "Fan"), ("Component_11_Name", ""), ("Component_12_Object_Type", "Fan"), ("Component_12_Name", "late")]
    rows = [("m", "Branch", 7, n, *f) for n, f in enumerate(fields)]
    objects = spark.createDataFrame(rows, "model string, obj_type string, obj_idx long, field_idx int, field_name string, value string")
    written = []
    real = topology.cut_lineage
    monkeypatch.setattr(topology, "cut_lineage", lambda df: written.append(df) or real(df))
    got = sorted(tuple(r) for r in topology.components(objects, "Branch").collect())
    assert got == [("m", "Branch", "b", 2, "Fan", "f", "i", "o"), ("m", "Branch", "b", 10, "Coil", "c", None, None)]
    assert len(topology.components(objects, "Branch", stop_at_blank=False).collect()) == 4
    # fields are sorted after they are shuffled, not in the task that reads them, and in one place
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_max" not in plan.split("Exchange hashpartitioning")[-1]
