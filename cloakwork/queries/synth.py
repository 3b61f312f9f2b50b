"""Expressions over customer that Spark SQL and DuckDB read alike, and helpers to register queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloakwork.functions.fixed import ID_CHECKS, ID_WEIGHTS, USCC_ALPHABET

Query = Callable[[SparkSession, str], DataFrame]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def txt(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def pick(words: str, by: str) -> str:
    return f"substr('{words}', 1 + CAST({by} AS INT), 1)"


def div(expr: str, n: int) -> str:
    return f"CAST(floor({expr} / {n}) AS BIGINT)"


K = "c_custkey"
SURNAME = pick("张李王赵陈", f"{K} % 5")
GIVEN = pick("伟芳强敏静", f"{div(K, 5)} % 5")
NAME = f"concat({SURNAME}, {GIVEN})"
PHONE = f"concat('1', {txt(f'3 + {K} % 7')}, lpad({txt(K)}, 9, '0'))"
FILE = f"concat('f', {txt(f'{K} % 10')}, '.docx')"
DATE = f"concat({txt(f'1950 + {K} % 60')}, '年', {txt(f'1 + {K} % 12')}, '月', {txt(f'1 + {K} % 28')}, '日')"
COMPANY = f"concat('北京', {GIVEN}, {SURNAME}, '科技有限公司')"
ADDRESS = f"concat('深圳市福田区', {GIVEN}, {SURNAME}, '路', {txt(f'1 + {K} % 90')}, '号')"


def _digit(base: str, i: int) -> str:
    return f"CAST(substr({base}, {i + 1}, 1) AS INT)"


_ID_BASE = f"concat('110105', {txt(f'1950 + {K} % 50')}, lpad({txt(f'1 + {K} % 12')}, 2, '0'), lpad({txt(f'1 + {K} % 28')}, 2, '0'), lpad({txt(f'{K} % 1000')}, 3, '0'))"
_ID_SUM = " + ".join(f"{_digit(_ID_BASE, i)} * {w}" for i, w in enumerate(ID_WEIGHTS))


def id_number(wrong: int = 0) -> str:
    return f"concat({_ID_BASE}, substr('{ID_CHECKS}', 1 + CAST(({_ID_SUM} + {wrong}) % 11 AS INT), 1))"


_CARD_BASE = f"concat('622202', lpad({txt(K)}, 9, '0'))"
_CARD_SUM = " + ".join(f"CASE WHEN {_digit(_CARD_BASE, i)} * 2 > 9 THEN {_digit(_CARD_BASE, i)} * 2 - 9 ELSE {_digit(_CARD_BASE, i)} * 2 END" if i % 2 == 0 else _digit(_CARD_BASE, i) for i in range(15))


def card(wrong: int = 0) -> str:
    return f"concat({_CARD_BASE}, {txt(f'(10 - ({_CARD_SUM}) % 10 + {wrong}) % 10')})"


_USCC_BASE = f"concat('91', '110108', lpad({txt(K)}, 9, '0'))"
_USCC_SUM = " + ".join(f"(instr('{USCC_ALPHABET}', substr({_USCC_BASE}, {i + 1}, 1)) - 1) * {3**i % 31}" for i in range(17))


def uscc(wrong: int = 0) -> str:
    return f"concat({_USCC_BASE}, substr('{USCC_ALPHABET}', 1 + CAST((31 - ({_USCC_SUM}) % 31 + {wrong}) % 31 AS INT), 1))"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        self.queries[name] = query
        if sql:
            self.oracles[name] = sql


def customers(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return load(spark, sf_dir, "customer").selectExpr(K, *[f"{v} AS {k}" for k, v in columns.items()])
