"""A small project of several languages, as rows (file, text): the input of queries over source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "shop/__init__.py": "from .cart import Cart as Cart\nfrom .util import money\n",
    "shop/cart.py": '''"""Carts."""
import os
from typing import TYPE_CHECKING
from .util import money, LIMIT
import requests

if TYPE_CHECKING:
    from .store import Store

COUNT = 0
SEEN = []


class Base:
    def total(self):
        return 0

    def label(self):
        return "base"


class Cart(Base):
    """What a customer wants to buy."""

    def __init__(self, store):
        self.store = store

    def total(self):
        return money(self.raw())

    def raw(self):
        return 1

    def describe(self):
        return self.label() + str(self.total())


def add(cart, item):
    global COUNT
    COUNT = COUNT + 1
    SEEN.append(item)
    return requests.post("http://localhost/api/items/{}", json=item)


def limit():
    return os.environ["SHOP_LIMIT"] or LIMIT
''',
    "shop/util.py": 'LIMIT = 10\n\n\ndef money(x):\n    return round(x, 2)\n\n\ndef helper():\n    import os\n\n    return os.getenv("SHOP_LIMIT")\n',
    "shop/store.py": "from shop import Cart, money\nfrom shop.cart import add\n\n\nclass Store:\n    def open(self):\n        c = Cart(self)\n        add(c, 1)\n        return money(2)\n\n    def report(self):\n        return unheard(1)\n",
    "shop/api.py": 'from flask import Flask\nfrom .store import Store\n\napp = Flask(__name__)\n\n\n@app.get("/api/items/<id>")\ndef show(id):\n    return Store().open()\n\n\n@app.route("/api/items/<id>", methods=["POST"])\ndef create(id):\n    return lone_helper_name(id)\n\n\ndef lone_helper_name(x):\n    return x\n',
    "tests/test_cart.py": "from shop.cart import Cart, add\n\n\ndef test_total():\n    assert Cart(None).total() == 1\n    add(None, 2)\n",
    "web/src/api.ts": "import { format } from './format';\nimport axios from 'axios';\n\nexport interface Priced {\n  price(): number;\n}\n\nexport class Item implements Priced {\n  price(): number {\n    return format(1);\n  }\n}\n\nexport async function load(id) {\n  return axios.get(`/api/items/${id}`);\n}\n",
    "web/src/format/index.ts": "export const format = (n) => {\n  return n;\n};\n",
    "core/cart.go": 'package core\n\nimport (\n\t"fmt"\n\t"github.com/gin-gonic/gin"\n)\n\ntype Cart struct {\n\titems int\n}\n\nfunc (c *Cart) Total() int {\n\treturn sum(c.items)\n}\n\nfunc sum(n int) int {\n\tfmt.Println(n)\n\treturn n\n}\n\nfunc Routes(r *gin.Engine) {\n\tr.GET("/health", health)\n}\n\nfunc health(c *gin.Context) {\n}\n',
    "docs/guide.md": "# Guide\n\nIntro.\n\n## Install\n\nRun it.\n\n```\n# not a heading\n```\n\n## Use\n\n### Carts\n\nAdd things.\n\n# Appendix\n",
}


def sample_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FILES.items()), "file string, text string")


#: A file of each further language.
POLYGLOT = {
    "web/Cart.tsx": "import React, { useState as state } from 'react';\nimport type { Priced } from './types';\nexport { Shelf } from './shelf';\nexport class Cart extends Base implements Priced, Named {\n  total(a: number): number {\n    if (a) {\n      return this.sum(a);\n    }\n  }\n}\nexport interface Named { }\ntype Money = number;\nconst tax = (x) => x * 2;\n",
    "web/server.js": "const express = require('express');\nconst app = express();\napp.get('/carts/:id', show);\napp.post('/carts', auth, create);\n// app.get('/no', no);\nfunction show(req, res) {\n  return axios.get('/health');\n}\nfunction create(req, res) {\n  bus.emit('cart.made', 1);\n}\n",
    "src/ItemsController.java": 'package shop;\n\nimport org.springframework.web.bind.annotation.*;\nimport shop.store.Store;\n\n@RestController\n@RequestMapping("/api")\npublic class ItemsController extends Base implements Named, Listed<Item> {\n    public ItemsController(Store store) {\n    }\n\n    @GetMapping("/items/{id}")\n    public List<String> find(String id) throws Missing {\n        return store.find(id);\n    }\n}\n',
    "src/Shapes.kt": "import io.ktor.server.routing.*\n\ndata class Point(val x: Int) : Base(x), Named {\n    fun area(): Int {\n        return 1\n    }\n}\n\nfun String.shout() = 1\n\nfun Route.shapes() {\n    get(\"/shapes\") {\n    }\n}\n",
    "src/Actors.scala": "import a.b.{C, D}\n\nclass Actor extends Base with Logging {\n  def act(n: Int) = {\n    run(n)\n  }\n}\n",
    "src/Items.cs": 'using Microsoft.AspNetCore.Mvc;\n\nnamespace Shop {\n  [Route("api/[controller]")]\n  public class ItemsController : ControllerBase, IThing {\n    [HttpGet("{id}")]\n    public string Get(int id) {\n      return Find(id);\n    }\n  }\n}\n',
    "src/shape.rs": 'use actix_web::get;\nuse std::env;\n\n/// A point.\npub struct Point {\n    x: i32,\n}\n\nimpl Shape for Point {\n    fn area(&self) -> f64 {\n        env::var("UNIT").unwrap()\n    }\n}\n\n#[get("/shapes/{id}")]\nasync fn show() {}\n',
    "src/View.swift": "import Foundation\n\nclass View: Base, Drawable {\n  func draw() {\n    paint()\n  }\n}\n\nextension View {\n  func more() {}\n}\n",
    "src/list.c": "#include <stdio.h>\n#include \"list.h\"\n#define LIMIT 3\n\nstruct node { int x; };\n\n#if WIDE\nint size(int a) {\n  return 1;\n}\n#else\nint size(int a) {\n  return 2;\n}\n#endif\n\nstatic void *make(void)\n{\n  return grow(size(1));\n}\n",
    "src/tree.cpp": "#include <vector>\n\nnamespace shop {\nclass Tree : public Base {\n public:\n  int depth();\n};\n\nint Tree::depth() {\n  return count(1);\n}\n}\n",
    "lib/cart.rb": "require 'set'\n\nmodule Shop\n  # A cart.\n  class Cart < Base\n    include Comparable\n    MAX_ITEMS = 3\n\n    def total\n      sum(1)\n    end\n  end\nend\n",
    "config/routes.rb": "Rails.application.routes.draw do\n  resources :items, only: [:index, :show]\n  get '/about', to: 'pages#about'\nend\n",
    "app/User.php": "<?php\n\nnamespace App\\Models;\n\nuse App\\Base;\n\nclass User extends Base implements Named\n{\n    public function name() {\n        return title(1);\n    }\n}\n\nRoute::get('/users/{id}', [UserController::class, 'show']);\n",
    "docs/index.rst": "Title\n=====\n\nText.\n\nPart\n----\n\nMore.\n\nOther\n=====\n",
    "broken.py": "def f(:\n",
}


def polyglot_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(POLYGLOT.items()), "file string, text string")


#: ``git log --name-status`` with a separator before each commit, newest first; and the files that are tracked.
LOG = "\x1ec5\nM\tsrc/new.py\nM\tsrc/b.py\n\x1ec4\nR090\tsrc/mid.py\tsrc/new.py\nM\tsrc/b.py\n\x1ec3\nM\tsrc/mid.py\nA\tsrc/c.py\nD\tsrc/gone.py\n\x1ec2\nR100\tsrc/old.py\tsrc/mid.py\n\x1ec1\nA\tsrc/old.py\nA\tsrc/b.py\n"
TRACKED = ("src/new.py", "src/b.py", "src/c.py")
STATUS = " M src/a.py\x00R  src/new.py\x00src/R  old.py\x00?? notes.txt\x00 D src/gone.py\x00"
DIFF = "M\x00src/a.py\x00R087\x00src/old.py\x00src/new.py\x00A\x00D\x00D\x00src/gone.py\x00M\x00src/b.js\x00"
BEFORE = {"src/a.py": "x = 1\n", "src/old.py": "def f():\n    return 1\n", "src/gone.py": "1\n", "src/b.js": "f(1); // one\n", "src/c.js": "let s = 'a'\n"}
AFTER = {"src/a.py": "# note\nx   = 1\n", "src/new.py": "def f():\n    return 2\n", "D": "y\n", "src/b.js": "f( 1 ) ; /* uno */\n", "src/c.js": "let s = 'b'\n"}


def texts(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(files.items()), "file string, text string")
