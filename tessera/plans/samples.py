"""A small invented project, the fixed code corpus of the code queries, and SQL for rows that are written out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MODELS = '''"""Things that are sold."""
from abc import ABC, abstractmethod

TAX = 20


class Item(ABC):
    def __init__(self, name, price):
        self.name = name
        self.price = price

    @abstractmethod
    def total(self):
        """Price with tax."""


class Book(Item):
    def total(self):
        return self.price


class Tool(Item):
    def total(self):
        return with_tax(self.price)


class Kit(Book, Tool):
    pass


def with_tax(price):
    """Return the price plus tax."""
    if price < 0:
        raise ValueError("negative")
    return price + price * TAX // 100
'''
STORE = '''import os
from shop.models import Book, with_tax


def load(path):
    f = open(path)
    rows = f.read()
    if not rows:
        return []
    f.close()
    return rows.split()


def save(path, rows):
    with open(path, "w") as f:
        f.write(" ".join(rows))


def run(cmd):
    name = input()
    os.system(name)
    os.system(int(name))
    unused = 1
    return cmd


def price_of(n):
    b = Book("b", n)
    return with_tax(b.total())


def _old(x):
    limit = 3
    if limit > 2:
        y = x + 1
    else:
        y = 0
    z = 1 + x
    return y * z
'''
API = '''from shop import store


def handle(path, n):
    rows = store.load(path)
    total = 0
    for r in rows:
        total = total + store.price_of(n)
    return total


def main():
    return handle("x", 1)
'''
VIEWS = '''class Log:
    def write(self, text):
        pass

    def clear(self):
        pass

    def size(self):
        return 0


class Desk:
    def __init__(self):
        self.log = Log()

    def write(self, text):
        self.log.write(text)

    def clear(self):
        self.log.clear()

    def size(self):
        return self.log.size()


class Quiet(Log):
    def hush(self):
        return 1


class Bill:
    def __init__(self):
        self.sum = 0

    def draw(self, page: Page):
        page.open()
        page.line(page.width)
        page.close()
        return self.sum


class Page:
    def open(self):
        pass

    def line(self, n):
        pass

    def close(self):
        pass
'''
TESTS = '''from shop.api import handle


def test_handle():
    assert handle("x", 2) == 0
'''
MATHS = '''def area(a, b):
    one = a * b
    two = b * a
    base = 2
    half = base * 3
    if half > 5:
        rest = one
    else:
        rest = two
    return rest


def tail(path):
    f = open(path)
    last = f.read()
    f.close()
    f.close()
    return last
'''
FILES = (("shop/models.py", MODELS), ("shop/store.py", STORE), ("shop/api.py", API), ("shop/maths.py", MATHS), ("shop/views.py", VIEWS), ("tests/test_api.py", TESTS), ("shop/broken.py", "def :\n"))


JS = '''import { round } from "./util";
const fs = require("fs");

export class Cart extends Base {
  constructor(items) {
    this.items = items;
  }

  total(tax) {
    let sum = 0;
    for (const i of this.items) {
      if (i.price > 0 && i.on) {
        sum += price(i); // if
      }
    }
    return this.rounded(sum * tax);
  }

  rounded(x) {
    return round(x);
  }
}

function price(i) {
  return i.price ? round(i.price) : 0;
}

export const show = (c) => {
  console.log(c.total(1));
};
'''
GO = '''package main

import (
    "fmt"
)

type Cart struct {
    n int
}

func (c *Cart) Add(k int, v string) error {
    if k > 1 || v == "" {
        return fmt.Errorf("no: %s", v)
    }
    c.n += k
    return nil
}

func main() {
    c := Cart{}
    c.Add(1, "x")
    run("{")
}
'''
RUST = '''use std::fs;

pub struct Cart { n: u32 }

impl Cart {
    pub fn add(&mut self, k: u32) -> u32 {
        match k {
            0 => 0,
            _ => { self.n += k; self.n }
        }
    }
}

fn main() {
    let mut c = Cart { n: 0 };
    c.add(2);
    fs::read("x");
}
'''
JAVA = '''package a;
import java.util.List;

public class Cart extends Base implements Shown {
    private int n;

    public Cart(int n) {
        this.n = n;
    }

    public int add(List<String> k, int v) throws Bad {
        while (v > 0) { v--; }
        return helper(k);
    }

    abstract int helper(List<String> k);
}
'''
C = '''#include <stdio.h>
#include "cart.h"

struct cart { int n; };

static int add(struct cart *c, int k)
{
    if (k < 0) {
        return -1;
    }
    c->n += k;
    printf("%d {", c->n);
    return c->n;
}

int main(void) {
    return add(0, 1);
}
'''
BRACES = (("web/cart.js", JS), ("srv/cart.go", GO), ("srv/cart.rs", RUST), ("srv/Cart.java", JAVA), ("lib/cart.c", C), ("notes.txt", "no code {"))


def brace_files(spark: SparkSession) -> DataFrame:
    """(path, content): files in languages with braces, and one that is none."""
    return spark.createDataFrame(list(BRACES), "path string, content string")


def files(spark: SparkSession) -> DataFrame:
    """(path, content): the project; seven files, one of which does not parse."""
    return spark.createDataFrame(list(FILES), "path string, content string")


def rows_sql(columns: str, rows: str) -> str:
    """SQL of rows that are written out: a line a row, columns apart by |; a column is "name type", empty text is null but for strings."""
    names = [c.split() for c in columns.split(", ")]

    def cell(value: str, kind: str) -> str:
        if kind != "VARCHAR":
            return f"{value}::{kind}" if value else f"NULL::{kind}"
        return "'" + value.replace("'", "''") + "'"

    made = []
    for line in rows.strip("\n").splitlines():
        cells = line.split("|")
        if len(cells) != len(names):
            raise ValueError(f"{len(cells)} cells, not {len(names)}: {line}")
        made.append(f"({', '.join(cell(x, k) for x, (_, k) in zip(cells, names, strict=True))})")
    return f"SELECT * FROM (VALUES {', '.join(made)}) t({', '.join(n for n, _ in names)})"
