"""Walks physical plans; subqueries are expressions and not walked."""


def nodes(plan):
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
        return
    if kind.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
        return
    yield kind, plan
    children = plan.children().iterator()
    while children.hasNext():
        yield from nodes(children.next())


def plan_nodes(df):
    return list(nodes(df._jdf.queryExecution().executedPlan()))
