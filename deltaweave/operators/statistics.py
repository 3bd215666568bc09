"""Counters of a module's functions, globals, blocks and instructions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counter -> op of the instructions that it counts.
OPS = {"stores": "store", "loads": "load", "branches": "branch", "switches": "switch", "address_computations": "address", "landing_pads": "landing", "phi_nodes": "phi", "call_sites": "call"}
#: Counter -> what the calls that it counts call.
CALLS = {"indirect_calls": "indirect", "inline_asm": "asm", "memory_intrinsics": "memory", "debug_intrinsics": "debug"}


def _long(rows: DataFrame, **counters: Column) -> DataFrame:
    """(counter, value): one aggregation of rows, one row for each counter."""
    one = rows.agg(*(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in counters.items()))
    return one.unpivot([], list(counters), "counter", "value")


def module_counters(functions: DataFrame, variables: DataFrame, blocks: DataFrame, edges: DataFrame, instructions: DataFrame, uses: DataFrame) -> DataFrame:
    """(counter, value): 34 counters and the number of allocated types.

    functions(external, defined, address_taken), variables(external, defined, constant), blocks(block), edges(src, dst) between blocks,
    instructions(op, callee, void, operands, type), uses(n, outside): instruction n is an operand, outside of its block or not.  `callee`
    says for calls what is called: allocating, indirect, asm, memory, debug or anything else; `type` is what an instruction allocates.
    External is linkage, whether defined or not.  The largest counts are true maxima.  Nulls count as false; of no rows all counters are 0."""
    given, call = F.col("op"), F.col("op") == "call"
    used = uses.groupBy("n").agg(F.count("*").alias("k"), F.max("outside").alias("outside"))
    ins, outs = edges.groupBy("dst").agg(F.count("*").alias("k")), edges.groupBy("src").agg(F.count("*").alias("k"))
    parts = [
        _long(functions, functions=F.count("*"), external_functions=F.count_if("external"), function_definitions=F.count_if("defined"), address_taken_functions=F.count_if("address_taken")),
        _long(variables, globals=F.count("*"), external_globals=F.count_if("external"), global_definitions=F.count_if("defined"), global_constants=F.count_if("constant")),
        _long(blocks, basic_blocks=F.count("*")),
        _long(ins, total_predecessors=F.sum("k"), max_predecessors=F.max("k")),
        _long(outs, total_successors=F.sum("k"), max_successors=F.max("k")),
        _long(
            instructions,
            instructions=F.count("*"),
            allocation_sites=F.count_if((given == "alloca") | (call & (F.col("callee") == "allocating"))),
            allocated_types=F.countDistinct("type"),
            total_operands=F.sum("operands"),
            max_operands=F.max("operands"),
            non_void=F.count_if(~F.col("void")),
            **{n: F.count_if(given == op) for n, op in OPS.items()},
            **{n: F.count_if(call & (F.col("callee") == kind)) for n, kind in CALLS.items()},
        ),
        _long(used, total_uses=F.sum("k"), max_uses=F.max("k"), multiple_uses=F.count_if(F.col("k") > 1), used_outside_block=F.count_if("outside")),
    ]
    return reduce(DataFrame.unionByName, parts)
