"""Expected rows of the sample cases: (columns with their SQL types, rows).

The rows of hand-made graphs were written by hand; most others were taken from a run and read against the sample's
sources, so they hold the operators to what they gave then, not to a second implementation.
"""

from __future__ import annotations


GOLDEN: dict[str, tuple[str, list[tuple]]] = {
    "code_definitions": (
        "file VARCHAR, kind VARCHAR, name VARCHAR, line INTEGER, end_line INTEGER, least_args INTEGER, most_args INTEGER",
        [
            ('core/cart.go', 'function', 'Routes', 21, 23, None, None),
            ('core/cart.go', 'function', 'health', 25, 26, None, None),
            ('core/cart.go', 'function', 'sum', 16, 19, None, None),
            ('core/cart.go', 'method', 'Cart.Total', 12, 14, None, None),
            ('core/cart.go', 'struct', 'Cart', 8, 10, None, None),
            ('shop/api.py', 'function', 'create', 13, 14, 1, 1),
            ('shop/api.py', 'function', 'lone_helper_name', 17, 18, 1, 1),
            ('shop/api.py', 'function', 'show', 8, 9, 1, 1),
            ('shop/api.py', 'variable', 'app', 4, 4, None, None),
            ('shop/cart.py', 'class', 'Base', 14, 19, None, None),
            ('shop/cart.py', 'class', 'Cart', 22, 35, None, None),
            ('shop/cart.py', 'constant', 'COUNT', 10, 10, None, None),
            ('shop/cart.py', 'constant', 'SEEN', 11, 11, None, None),
            ('shop/cart.py', 'function', 'add', 38, 42, 2, 2),
            ('shop/cart.py', 'function', 'limit', 45, 46, 0, 0),
            ('shop/cart.py', 'method', 'Base.label', 18, 19, 0, 0),
            ('shop/cart.py', 'method', 'Base.total', 15, 16, 0, 0),
            ('shop/cart.py', 'method', 'Cart.__init__', 25, 26, 1, 1),
            ('shop/cart.py', 'method', 'Cart.describe', 34, 35, 0, 0),
            ('shop/cart.py', 'method', 'Cart.raw', 31, 32, 0, 0),
            ('shop/cart.py', 'method', 'Cart.total', 28, 29, 0, 0),
            ('shop/store.py', 'class', 'Store', 5, 12, None, None),
            ('shop/store.py', 'method', 'Store.open', 6, 9, 0, 0),
            ('shop/store.py', 'method', 'Store.report', 11, 12, 0, 0),
            ('shop/util.py', 'constant', 'LIMIT', 1, 1, None, None),
            ('shop/util.py', 'function', 'helper', 8, 11, 0, 0),
            ('shop/util.py', 'function', 'money', 4, 5, 1, 1),
            ('tests/test_cart.py', 'function', 'test_total', 4, 6, 0, 0),
            ('web/src/api.ts', 'class', 'Item', 8, 12, None, None),
            ('web/src/api.ts', 'function', 'load', 14, 16, None, None),
            ('web/src/api.ts', 'interface', 'Priced', 4, 6, None, None),
            ('web/src/api.ts', 'method', 'Item.price', 9, 11, None, None),
            ('web/src/format/index.ts', 'function', 'format', 1, 3, None, None),
        ],
    ),
    "code_imports": (
        "file VARCHAR, line INTEGER, name VARCHAR, target VARCHAR, level INTEGER, runs VARCHAR",
        [
            ('core/cart.go', 4, 'fmt', 'fmt', 0, 'module-level'),
            ('core/cart.go', 5, 'gin', 'github.com/gin-gonic/gin', 0, 'module-level'),
            ('shop/__init__.py', 1, 'Cart', 'cart:Cart', 1, 'module-level'),
            ('shop/__init__.py', 2, 'money', 'util:money', 1, 'module-level'),
            ('shop/api.py', 1, 'Flask', 'flask:Flask', 0, 'module-level'),
            ('shop/api.py', 2, 'Store', 'store:Store', 1, 'module-level'),
            ('shop/cart.py', 2, 'os', 'os', 0, 'module-level'),
            ('shop/cart.py', 3, 'TYPE_CHECKING', 'typing:TYPE_CHECKING', 0, 'module-level'),
            ('shop/cart.py', 4, 'LIMIT', 'util:LIMIT', 1, 'module-level'),
            ('shop/cart.py', 4, 'money', 'util:money', 1, 'module-level'),
            ('shop/cart.py', 5, 'requests', 'requests', 0, 'module-level'),
            ('shop/cart.py', 8, 'Store', 'store:Store', 1, 'type-checking'),
            ('shop/store.py', 1, 'Cart', 'shop:Cart', 0, 'module-level'),
            ('shop/store.py', 1, 'money', 'shop:money', 0, 'module-level'),
            ('shop/store.py', 2, 'add', 'shop.cart:add', 0, 'module-level'),
            ('shop/util.py', 9, 'os', 'os', 0, 'deferred'),
            ('tests/test_cart.py', 1, 'Cart', 'shop.cart:Cart', 0, 'module-level'),
            ('tests/test_cart.py', 1, 'add', 'shop.cart:add', 0, 'module-level'),
            ('web/src/api.ts', 1, '{ format }', './format', 0, 'module-level'),
            ('web/src/api.ts', 2, 'axios', 'axios', 0, 'module-level'),
        ],
    ),
    "code_calls": (
        "file VARCHAR, owner VARCHAR, kind VARCHAR, target VARCHAR, line INTEGER",
        [
            ('core/cart.go', 'Cart.Total', 'call', 'sum', 13),
            ('core/cart.go', 'Routes', 'call', 'r.GET', 22),
            ('core/cart.go', 'sum', 'call', 'fmt.Println', 17),
            ('shop/api.py', '', 'call', 'Flask', 4),
            ('shop/api.py', 'create', 'call', 'lone_helper_name', 14),
            ('shop/api.py', 'create', 'decorator', 'app.route', 12),
            ('shop/api.py', 'show', 'call', 'Store', 9),
            ('shop/api.py', 'show', 'decorator', 'app.get', 7),
            ('shop/cart.py', 'Cart.describe', 'call', 'self.label', 35),
            ('shop/cart.py', 'Cart.describe', 'call', 'self.total', 35),
            ('shop/cart.py', 'Cart.describe', 'call', 'str', 35),
            ('shop/cart.py', 'Cart.total', 'call', 'money', 29),
            ('shop/cart.py', 'Cart.total', 'call', 'self.raw', 29),
            ('shop/cart.py', 'add', 'call', 'SEEN.append', 41),
            ('shop/cart.py', 'add', 'call', 'requests.post', 42),
            ('shop/store.py', 'Store.open', 'call', 'Cart', 7),
            ('shop/store.py', 'Store.open', 'call', 'add', 8),
            ('shop/store.py', 'Store.open', 'call', 'money', 9),
            ('shop/store.py', 'Store.report', 'call', 'unheard', 12),
            ('shop/util.py', 'helper', 'call', 'os.getenv', 11),
            ('shop/util.py', 'money', 'call', 'round', 5),
            ('tests/test_cart.py', 'test_total', 'call', 'Cart', 5),
            ('tests/test_cart.py', 'test_total', 'call', 'add', 6),
            ('web/src/api.ts', 'Item.price', 'call', 'format', 10),
            ('web/src/api.ts', 'load', 'call', 'axios.get', 15),
        ],
    ),
    "code_state": (
        "file VARCHAR, owner VARCHAR, fact VARCHAR, kind VARCHAR, target VARCHAR, line INTEGER",
        [
            ('shop/cart.py', 'add', 'read', 'name', 'COUNT', 40),
            ('shop/cart.py', 'add', 'read', 'name', 'SEEN', 41),
            ('shop/cart.py', 'add', 'write', 'mutated', 'SEEN', 41),
            ('shop/cart.py', 'add', 'write', 'name', 'COUNT', 40),
        ],
    ),
    "code_headings": (
        "file VARCHAR, name VARCHAR, level INTEGER, line INTEGER, end_line INTEGER",
        [
            ('docs/guide.md', 'Appendix', 1, 19, 20),
            ('docs/guide.md', 'Carts', 3, 15, 18),
            ('docs/guide.md', 'Guide', 1, 1, 18),
            ('docs/guide.md', 'Install', 2, 5, 12),
            ('docs/guide.md', 'Use', 2, 13, 18),
            ('docs/index.rst', 'Other', 1, 11, 13),
            ('docs/index.rst', 'Part', 2, 6, 10),
            ('docs/index.rst', 'Title', 1, 1, 10),
        ],
    ),
    "polyglot_definitions": (
        "file VARCHAR, language VARCHAR, kind VARCHAR, name VARCHAR, region_start INTEGER, line INTEGER, end_line INTEGER",
        [
            ('app/User.php', 'php', 'class', 'User', 7, 7, 12),
            ('app/User.php', 'php', 'method', 'User.name', 9, 9, 11),
            ('app/User.php', 'php', 'namespace', 'App.Models', 3, 3, 3),
            ('lib/cart.rb', 'ruby', 'class', 'Shop.Cart', 4, 5, 12),
            ('lib/cart.rb', 'ruby', 'constant', 'Shop.Cart.MAX_ITEMS', 7, 7, 7),
            ('lib/cart.rb', 'ruby', 'method', 'Shop.Cart.total', 9, 9, 11),
            ('lib/cart.rb', 'ruby', 'module', 'Shop', 3, 3, 13),
            ('src/Actors.scala', 'scala', 'class', 'Actor', 3, 3, 7),
            ('src/Actors.scala', 'scala', 'method', 'Actor.act', 4, 4, 6),
            ('src/Items.cs', 'csharp', 'class', 'Shop.ItemsController', 4, 5, 10),
            ('src/Items.cs', 'csharp', 'method', 'Shop.ItemsController.Get', 6, 7, 9),
            ('src/Items.cs', 'csharp', 'namespace', 'Shop', 3, 3, 11),
            ('src/ItemsController.java', 'java', 'class', 'ItemsController', 6, 8, 16),
            ('src/ItemsController.java', 'java', 'constructor', 'ItemsController.ItemsController', 9, 9, 10),
            ('src/ItemsController.java', 'java', 'method', 'ItemsController.find', 12, 13, 15),
            ('src/Shapes.kt', 'kotlin', 'class', 'Point', 3, 3, 7),
            ('src/Shapes.kt', 'kotlin', 'function', 'Route.shapes', 11, 11, 14),
            ('src/Shapes.kt', 'kotlin', 'function', 'String.shout', 9, 9, 9),
            ('src/Shapes.kt', 'kotlin', 'method', 'Point.area', 4, 4, 6),
            ('src/View.swift', 'swift', 'class', 'View', 3, 3, 7),
            ('src/View.swift', 'swift', 'extension', 'View', 9, 9, 11),
            ('src/View.swift', 'swift', 'method', 'View.draw', 4, 4, 6),
            ('src/View.swift', 'swift', 'method', 'View.more', 10, 10, 10),
            ('src/list.c', 'c', 'constant', 'LIMIT', 3, 3, 3),
            ('src/list.c', 'c', 'function', 'make', 17, 17, 20),
            ('src/list.c', 'c', 'function', 'size', 8, 8, 10),
            ('src/list.c', 'c', 'struct', 'node', 5, 5, 5),
            ('src/shape.rs', 'rust', 'extension', 'Point', 9, 9, 13),
            ('src/shape.rs', 'rust', 'function', 'show', 15, 16, 16),
            ('src/shape.rs', 'rust', 'method', 'Point.area', 10, 10, 12),
            ('src/shape.rs', 'rust', 'struct', 'Point', 4, 5, 7),
            ('src/tree.cpp', 'cpp', 'class', 'shop.Tree', 4, 4, 7),
            ('src/tree.cpp', 'cpp', 'function', 'Tree.depth', 9, 9, 11),
            ('src/tree.cpp', 'cpp', 'namespace', 'shop', 3, 3, 12),
            ('web/Cart.tsx', 'ts', 'class', 'Cart', 4, 4, 10),
            ('web/Cart.tsx', 'ts', 'function', 'tax', 13, 13, 13),
            ('web/Cart.tsx', 'ts', 'interface', 'Named', 11, 11, 11),
            ('web/Cart.tsx', 'ts', 'method', 'Cart.total', 5, 5, 9),
            ('web/Cart.tsx', 'ts', 'type_alias', 'Money', 12, 12, 12),
            ('web/server.js', 'js', 'function', 'create', 9, 9, 11),
            ('web/server.js', 'js', 'function', 'show', 5, 6, 8),
        ],
    ),
    "polyglot_imports": (
        "file VARCHAR, line INTEGER, target VARCHAR, name VARCHAR",
        [
            ('app/User.php', 5, 'App\\Base', 'Base'),
            ('lib/cart.rb', 1, 'set', 'set'),
            ('src/Actors.scala', 1, 'a.b.{C, D}', '{C, D}'),
            ('src/Items.cs', 1, 'Microsoft.AspNetCore.Mvc', 'Mvc'),
            ('src/ItemsController.java', 3, 'org.springframework.web.bind.annotation.*', 'annotation'),
            ('src/ItemsController.java', 4, 'shop.store.Store', 'Store'),
            ('src/Shapes.kt', 1, 'io.ktor.server.routing.*', 'routing'),
            ('src/View.swift', 1, 'Foundation', 'Foundation'),
            ('src/list.c', 1, 'stdio.h', 'stdio'),
            ('src/list.c', 2, 'list.h', 'list'),
            ('src/shape.rs', 1, 'actix_web::get', 'get'),
            ('src/shape.rs', 2, 'std::env', 'env'),
            ('src/tree.cpp', 1, 'vector', 'vector'),
            ('web/Cart.tsx', 1, 'react', 'React, { useState as state }'),
            ('web/Cart.tsx', 2, './types', '{ Priced }'),
            ('web/Cart.tsx', 3, './shelf', '{ Shelf }'),
            ('web/server.js', 1, 'express', 'express'),
        ],
    ),
    "polyglot_bases": (
        "file VARCHAR, owner VARCHAR, kind VARCHAR, target VARCHAR",
        [
            ('app/User.php', 'User', 'implements', 'Named'),
            ('app/User.php', 'User', 'inherits', 'Base'),
            ('lib/cart.rb', 'Shop.Cart', 'inherits', 'Base'),
            ('lib/cart.rb', 'Shop.Cart', 'mixes_in', 'Comparable'),
            ('src/Actors.scala', 'Actor', 'inherits', 'Base'),
            ('src/Actors.scala', 'Actor', 'mixes_in', 'Logging'),
            ('src/Items.cs', 'Shop.ItemsController', 'implements', 'IThing'),
            ('src/Items.cs', 'Shop.ItemsController', 'inherits', 'ControllerBase'),
            ('src/ItemsController.java', 'ItemsController', 'implements', 'Listed'),
            ('src/ItemsController.java', 'ItemsController', 'implements', 'Named'),
            ('src/ItemsController.java', 'ItemsController', 'inherits', 'Base'),
            ('src/Shapes.kt', 'Point', 'implements', 'Named'),
            ('src/Shapes.kt', 'Point', 'inherits', 'Base'),
            ('src/View.swift', 'View', 'implements', 'Drawable'),
            ('src/View.swift', 'View', 'inherits', 'Base'),
            ('src/shape.rs', 'Point', 'implements', 'Shape'),
            ('src/tree.cpp', 'shop.Tree', 'inherits', 'Base'),
            ('web/Cart.tsx', 'Cart', 'implements', 'Named'),
            ('web/Cart.tsx', 'Cart', 'implements', 'Priced'),
            ('web/Cart.tsx', 'Cart', 'inherits', 'Base'),
        ],
    ),
    "polyglot_routes": (
        "file VARCHAR, line INTEGER, method VARCHAR, pattern VARCHAR, framework VARCHAR, handler VARCHAR",
        [
            ('app/User.php', 14, 'GET', '/users/{}', 'laravel', 'UserController'),
            ('config/routes.rb', 2, 'GET', '/items', 'rails', 'items#index'),
            ('config/routes.rb', 2, 'GET', '/items/{}', 'rails', 'items#show'),
            ('config/routes.rb', 3, 'GET', '/about', 'rails', 'pages#about'),
            ('src/Items.cs', 6, 'GET', '/api/items/{}', 'aspnet', 'Get'),
            ('src/ItemsController.java', 12, 'GET', '/api/items/{}', 'spring', 'find'),
            ('src/Shapes.kt', 12, 'GET', '/shapes', 'ktor', ''),
            ('src/shape.rs', 15, 'GET', '/shapes/{}', 'actix', 'show'),
            ('web/server.js', 3, 'GET', '/carts/{}', 'web', 'show'),
            ('web/server.js', 4, 'POST', '/carts', 'web', 'create'),
        ],
    ),
    "polyglot_calls": (
        "file VARCHAR, owner VARCHAR, target VARCHAR, line INTEGER",
        [
            ('app/User.php', 'User.name', 'title', 10),
            ('lib/cart.rb', 'Shop.Cart.total', 'sum', 10),
            ('src/Actors.scala', 'Actor.act', 'run', 5),
            ('src/Items.cs', 'Shop.ItemsController.Get', 'Find', 8),
            ('src/ItemsController.java', 'ItemsController.find', 'store.find', 14),
            ('src/Shapes.kt', 'Route.shapes', 'get', 12),
            ('src/View.swift', 'View.draw', 'paint', 5),
            ('src/list.c', 'make', 'grow', 19),
            ('src/list.c', 'make', 'size', 19),
            ('src/shape.rs', 'Point.area', 'env.var', 11),
            ('src/tree.cpp', 'Tree.depth', 'count', 10),
            ('web/Cart.tsx', 'Cart.total', 'self.sum', 7),
            ('web/server.js', 'create', 'bus.emit', 10),
            ('web/server.js', 'show', 'axios.get', 7),
        ],
    ),
    "polyglot_uses": (
        "file VARCHAR, fact VARCHAR, kind VARCHAR, name VARCHAR, target VARCHAR, owner VARCHAR",
        [
            ('src/shape.rs', 'resource', 'env', 'reads', 'UNIT', 'Point.area'),
            ('web/server.js', 'request', 'request', 'GET', '/health', 'show'),
            ('web/server.js', 'resource', 'event', 'writes', 'cart.made', 'create'),
        ],
    ),
    "unreadable_files": (
        "file VARCHAR, kind VARCHAR",
        [
            ('broken.py', 'SyntaxError'),
        ],
    ),
    "code_nodes": (
        "id VARCHAR, label VARCHAR, type VARCHAR, kind VARCHAR, file VARCHAR, line INTEGER",
        [
            ('core_cart', 'cart.go', 'file', 'file', 'core/cart.go', 1),
            ('core_cart_cart', 'Cart', 'code', 'struct', 'core/cart.go', 8),
            ('core_cart_cart_total', '.Total()', 'code', 'method', 'core/cart.go', 12),
            ('core_cart_health', 'health()', 'code', 'function', 'core/cart.go', 25),
            ('core_cart_routes', 'Routes()', 'code', 'function', 'core/cart.go', 21),
            ('core_cart_sum', 'sum()', 'code', 'function', 'core/cart.go', 16),
            ('docs_guide', 'guide.md', 'file', 'file', 'docs/guide.md', 1),
            ('docs_guide_appendix', 'Appendix', 'document', 'heading', 'docs/guide.md', 19),
            ('docs_guide_carts', 'Carts', 'document', 'heading', 'docs/guide.md', 15),
            ('docs_guide_guide', 'Guide', 'document', 'heading', 'docs/guide.md', 1),
            ('docs_guide_install', 'Install', 'document', 'heading', 'docs/guide.md', 5),
            ('docs_guide_use', 'Use', 'document', 'heading', 'docs/guide.md', 13),
            ('shop_api', 'api.py', 'file', 'file', 'shop/api.py', 1),
            ('shop_api_app', 'app', 'state', 'variable', 'shop/api.py', 4),
            ('shop_api_create', 'create()', 'code', 'function', 'shop/api.py', 13),
            ('shop_api_lone_helper_name', 'lone_helper_name()', 'code', 'function', 'shop/api.py', 17),
            ('shop_api_show', 'show()', 'code', 'function', 'shop/api.py', 8),
            ('shop_cart', 'cart.py', 'file', 'file', 'shop/cart.py', 1),
            ('shop_cart_add', 'add()', 'code', 'function', 'shop/cart.py', 38),
            ('shop_cart_base', 'Base', 'code', 'class', 'shop/cart.py', 14),
            ('shop_cart_base_label', '.label()', 'code', 'method', 'shop/cart.py', 18),
            ('shop_cart_base_total', '.total()', 'code', 'method', 'shop/cart.py', 15),
            ('shop_cart_cart', 'Cart', 'code', 'class', 'shop/cart.py', 22),
            ('shop_cart_cart_describe', '.describe()', 'code', 'method', 'shop/cart.py', 34),
            ('shop_cart_cart_init', '.__init__()', 'code', 'method', 'shop/cart.py', 25),
            ('shop_cart_cart_raw', '.raw()', 'code', 'method', 'shop/cart.py', 31),
            ('shop_cart_cart_total', '.total()', 'code', 'method', 'shop/cart.py', 28),
            ('shop_cart_count', 'COUNT', 'state', 'constant', 'shop/cart.py', 10),
            ('shop_cart_limit', 'limit()', 'code', 'function', 'shop/cart.py', 45),
            ('shop_cart_seen', 'SEEN', 'state', 'constant', 'shop/cart.py', 11),
            ('shop_init', '__init__.py', 'file', 'file', 'shop/__init__.py', 1),
            ('shop_store', 'store.py', 'file', 'file', 'shop/store.py', 1),
            ('shop_store_store', 'Store', 'code', 'class', 'shop/store.py', 5),
            ('shop_store_store_open', '.open()', 'code', 'method', 'shop/store.py', 6),
            ('shop_store_store_report', '.report()', 'code', 'method', 'shop/store.py', 11),
            ('shop_util', 'util.py', 'file', 'file', 'shop/util.py', 1),
            ('shop_util_helper', 'helper()', 'code', 'function', 'shop/util.py', 8),
            ('shop_util_limit', 'LIMIT', 'state', 'constant', 'shop/util.py', 1),
            ('shop_util_money', 'money()', 'code', 'function', 'shop/util.py', 4),
            ('tests_test_cart', 'test_cart.py', 'file', 'file', 'tests/test_cart.py', 1),
            ('tests_test_cart_test_total', 'test_total()', 'code', 'function', 'tests/test_cart.py', 4),
            ('web_src_api', 'api.ts', 'file', 'file', 'web/src/api.ts', 1),
            ('web_src_api_item', 'Item', 'code', 'class', 'web/src/api.ts', 8),
            ('web_src_api_item_price', '.price()', 'code', 'method', 'web/src/api.ts', 9),
            ('web_src_api_load', 'load()', 'code', 'function', 'web/src/api.ts', 14),
            ('web_src_api_priced', 'Priced', 'code', 'interface', 'web/src/api.ts', 4),
            ('web_src_format_index', 'index.ts', 'file', 'file', 'web/src/format/index.ts', 1),
            ('web_src_format_index_format', 'format()', 'code', 'function', 'web/src/format/index.ts', 1),
        ],
    ),
    "code_containment": (
        "src VARCHAR, dst VARCHAR, relation VARCHAR",
        [
            ('core_cart', 'core_cart_cart', 'contains'),
            ('core_cart', 'core_cart_health', 'contains'),
            ('core_cart', 'core_cart_routes', 'contains'),
            ('core_cart', 'core_cart_sum', 'contains'),
            ('core_cart_cart', 'core_cart_cart_total', 'method'),
            ('docs_guide', 'docs_guide_appendix', 'contains'),
            ('docs_guide', 'docs_guide_carts', 'contains'),
            ('docs_guide', 'docs_guide_guide', 'contains'),
            ('docs_guide', 'docs_guide_install', 'contains'),
            ('docs_guide', 'docs_guide_use', 'contains'),
            ('shop_api', 'shop_api_app', 'defines'),
            ('shop_api', 'shop_api_create', 'contains'),
            ('shop_api', 'shop_api_lone_helper_name', 'contains'),
            ('shop_api', 'shop_api_show', 'contains'),
            ('shop_cart', 'shop_cart_add', 'contains'),
            ('shop_cart', 'shop_cart_base', 'contains'),
            ('shop_cart', 'shop_cart_cart', 'contains'),
            ('shop_cart', 'shop_cart_count', 'defines'),
            ('shop_cart', 'shop_cart_limit', 'contains'),
            ('shop_cart', 'shop_cart_seen', 'defines'),
            ('shop_cart_base', 'shop_cart_base_label', 'method'),
            ('shop_cart_base', 'shop_cart_base_total', 'method'),
            ('shop_cart_cart', 'shop_cart_cart_describe', 'method'),
            ('shop_cart_cart', 'shop_cart_cart_init', 'method'),
            ('shop_cart_cart', 'shop_cart_cart_raw', 'method'),
            ('shop_cart_cart', 'shop_cart_cart_total', 'method'),
            ('shop_store', 'shop_store_store', 'contains'),
            ('shop_store_store', 'shop_store_store_open', 'method'),
            ('shop_store_store', 'shop_store_store_report', 'method'),
            ('shop_util', 'shop_util_helper', 'contains'),
            ('shop_util', 'shop_util_limit', 'defines'),
            ('shop_util', 'shop_util_money', 'contains'),
            ('tests_test_cart', 'tests_test_cart_test_total', 'contains'),
            ('web_src_api', 'web_src_api_item', 'contains'),
            ('web_src_api', 'web_src_api_load', 'contains'),
            ('web_src_api', 'web_src_api_priced', 'contains'),
            ('web_src_api_item', 'web_src_api_item_price', 'method'),
            ('web_src_format_index', 'web_src_format_index_format', 'contains'),
        ],
    ),
    "import_targets": (
        "file VARCHAR, name VARCHAR, runs VARCHAR, target_file VARCHAR, symbol VARCHAR",
        [
            ('shop/__init__.py', 'Cart', 'module-level', 'shop/cart.py', 'Cart'),
            ('shop/__init__.py', 'money', 'module-level', 'shop/util.py', 'money'),
            ('shop/api.py', 'Store', 'module-level', 'shop/store.py', 'Store'),
            ('shop/cart.py', 'LIMIT', 'module-level', 'shop/util.py', 'LIMIT'),
            ('shop/cart.py', 'Store', 'type-checking', 'shop/store.py', 'Store'),
            ('shop/cart.py', 'money', 'module-level', 'shop/util.py', 'money'),
            ('shop/store.py', 'Cart', 'module-level', 'shop/__init__.py', 'Cart'),
            ('shop/store.py', 'add', 'module-level', 'shop/cart.py', 'add'),
            ('shop/store.py', 'money', 'module-level', 'shop/__init__.py', 'money'),
            ('tests/test_cart.py', 'Cart', 'module-level', 'shop/cart.py', 'Cart'),
            ('tests/test_cart.py', 'add', 'module-level', 'shop/cart.py', 'add'),
            ('web/src/api.ts', 'format', 'module-level', 'web/src/format/index.ts', 'format'),
        ],
    ),
    "import_bindings": (
        "file VARCHAR, name VARCHAR, target_file VARCHAR, symbol VARCHAR",
        [
            ('shop/__init__.py', 'Cart', 'shop/cart.py', 'Cart'),
            ('shop/__init__.py', 'money', 'shop/util.py', 'money'),
            ('shop/api.py', 'Store', 'shop/store.py', 'Store'),
            ('shop/cart.py', 'LIMIT', 'shop/util.py', 'LIMIT'),
            ('shop/cart.py', 'Store', 'shop/store.py', 'Store'),
            ('shop/cart.py', 'money', 'shop/util.py', 'money'),
            ('shop/store.py', 'Cart', 'shop/cart.py', 'Cart'),
            ('shop/store.py', 'add', 'shop/cart.py', 'add'),
            ('shop/store.py', 'money', 'shop/util.py', 'money'),
            ('tests/test_cart.py', 'Cart', 'shop/cart.py', 'Cart'),
            ('tests/test_cart.py', 'add', 'shop/cart.py', 'add'),
            ('web/src/api.ts', 'format', 'web/src/format/index.ts', 'format'),
        ],
    ),
    "import_edges": (
        "src VARCHAR, dst VARCHAR, relation VARCHAR, runs VARCHAR",
        [
            ('shop_api', 'shop_store', 'imports_from', 'module-level'),
            ('shop_cart', 'shop_store', 'imports_from', 'type-checking'),
            ('shop_cart', 'shop_util', 'imports_from', 'module-level'),
            ('shop_init', 'shop_cart', 'imports_from', 'module-level'),
            ('shop_init', 'shop_util', 'imports_from', 'module-level'),
            ('shop_store', 'shop_cart', 'imports_from', 'module-level'),
            ('shop_store', 'shop_init', 'imports_from', 'module-level'),
            ('tests_test_cart', 'shop_cart', 'imports_from', 'module-level'),
            ('web_src_api', 'web_src_format_index', 'imports_from', 'module-level'),
        ],
    ),
    "resolved_names": (
        "file VARCHAR, owner VARCHAR, fact VARCHAR, target VARCHAR, line INTEGER, id VARCHAR, how VARCHAR, confidence VARCHAR",
        [
            ('core/cart.go', 'Cart.Total', 'call', 'sum', 13, 'core_cart_sum', 'scope', 'EXTRACTED'),
            ('core/cart.go', 'Routes', 'call', 'r.GET', 22, None, None, None),
            ('core/cart.go', 'sum', 'call', 'fmt.Println', 17, None, None, None),
            ('shop/api.py', '', 'call', 'Flask', 4, None, None, None),
            ('shop/api.py', 'create', 'call', 'app.route', 12, None, None, None),
            ('shop/api.py', 'create', 'call', 'lone_helper_name', 14, 'shop_api_lone_helper_name', 'scope', 'EXTRACTED'),
            ('shop/api.py', 'show', 'call', 'Store', 9, 'shop_store_store', 'import', 'EXTRACTED'),
            ('shop/api.py', 'show', 'call', 'app.get', 7, None, None, None),
            ('shop/cart.py', 'Cart', 'base', 'Base', 22, 'shop_cart_base', 'scope', 'EXTRACTED'),
            ('shop/cart.py', 'Cart.describe', 'call', 'self.label', 35, 'shop_cart_base_label', 'member', 'EXTRACTED'),
            ('shop/cart.py', 'Cart.describe', 'call', 'self.total', 35, 'shop_cart_cart_total', 'member', 'EXTRACTED'),
            ('shop/cart.py', 'Cart.describe', 'call', 'str', 35, None, None, None),
            ('shop/cart.py', 'Cart.total', 'call', 'money', 29, 'shop_util_money', 'import', 'EXTRACTED'),
            ('shop/cart.py', 'Cart.total', 'call', 'self.raw', 29, 'shop_cart_cart_raw', 'member', 'EXTRACTED'),
            ('shop/cart.py', 'add', 'call', 'SEEN.append', 41, None, None, None),
            ('shop/cart.py', 'add', 'call', 'requests.post', 42, None, None, None),
            ('shop/cart.py', 'add', 'read', 'COUNT', 40, 'shop_cart_count', 'scope', 'EXTRACTED'),
            ('shop/cart.py', 'add', 'read', 'SEEN', 41, 'shop_cart_seen', 'scope', 'EXTRACTED'),
            ('shop/cart.py', 'add', 'write', 'COUNT', 40, 'shop_cart_count', 'scope', 'EXTRACTED'),
            ('shop/cart.py', 'add', 'write', 'SEEN', 41, 'shop_cart_seen', 'scope', 'EXTRACTED'),
            ('shop/store.py', 'Store.open', 'call', 'Cart', 7, 'shop_cart_cart', 'import', 'EXTRACTED'),
            ('shop/store.py', 'Store.open', 'call', 'add', 8, 'shop_cart_add', 'import', 'EXTRACTED'),
            ('shop/store.py', 'Store.open', 'call', 'money', 9, 'shop_util_money', 'import', 'EXTRACTED'),
            ('shop/store.py', 'Store.report', 'call', 'unheard', 12, None, None, None),
            ('shop/util.py', 'helper', 'call', 'os.getenv', 11, None, None, None),
            ('shop/util.py', 'money', 'call', 'round', 5, None, None, None),
            ('tests/test_cart.py', 'test_total', 'call', 'Cart', 5, 'shop_cart_cart', 'import', 'EXTRACTED'),
            ('tests/test_cart.py', 'test_total', 'call', 'add', 6, 'shop_cart_add', 'import', 'EXTRACTED'),
            ('web/src/api.ts', 'Item', 'base', 'Priced', 8, 'web_src_api_priced', 'scope', 'EXTRACTED'),
            ('web/src/api.ts', 'Item.price', 'call', 'format', 10, 'web_src_format_index_format', 'import', 'EXTRACTED'),
            ('web/src/api.ts', 'load', 'call', 'axios.get', 15, None, None, None),
        ],
    ),
    "code_edges": (
        "src VARCHAR, dst VARCHAR, relation VARCHAR, confidence VARCHAR, line INTEGER",
        [
            ('core_cart_cart_total', 'core_cart_sum', 'calls', 'EXTRACTED', 13),
            ('shop_api_create', 'shop_api_lone_helper_name', 'calls', 'EXTRACTED', 14),
            ('shop_api_show', 'shop_store_store', 'calls', 'EXTRACTED', 9),
            ('shop_cart_add', 'shop_cart_count', 'reads', 'EXTRACTED', 40),
            ('shop_cart_add', 'shop_cart_count', 'writes', 'EXTRACTED', 40),
            ('shop_cart_add', 'shop_cart_seen', 'reads', 'EXTRACTED', 41),
            ('shop_cart_add', 'shop_cart_seen', 'writes', 'INFERRED', 41),
            ('shop_cart_cart', 'shop_cart_base', 'inherits', 'EXTRACTED', 22),
            ('shop_cart_cart_describe', 'shop_cart_base_label', 'calls', 'EXTRACTED', 35),
            ('shop_cart_cart_describe', 'shop_cart_cart_total', 'calls', 'EXTRACTED', 35),
            ('shop_cart_cart_total', 'shop_cart_cart_raw', 'calls', 'EXTRACTED', 29),
            ('shop_cart_cart_total', 'shop_util_money', 'calls', 'EXTRACTED', 29),
            ('shop_store_store_open', 'shop_cart_add', 'calls', 'EXTRACTED', 8),
            ('shop_store_store_open', 'shop_cart_cart', 'calls', 'EXTRACTED', 7),
            ('shop_store_store_open', 'shop_cart_cart_init', 'calls', 'EXTRACTED', 7),
            ('shop_store_store_open', 'shop_util_money', 'calls', 'EXTRACTED', 9),
            ('tests_test_cart_test_total', 'shop_cart_add', 'calls', 'EXTRACTED', 6),
            ('tests_test_cart_test_total', 'shop_cart_cart', 'calls', 'EXTRACTED', 5),
            ('tests_test_cart_test_total', 'shop_cart_cart_init', 'calls', 'EXTRACTED', 5),
            ('web_src_api_item', 'web_src_api_priced', 'implements', 'EXTRACTED', 8),
            ('web_src_api_item_price', 'web_src_format_index_format', 'calls', 'EXTRACTED', 10),
        ],
    ),
    "unresolved_calls": (
        "file VARCHAR, line INTEGER, target VARCHAR, reason VARCHAR",
        [
            ('core/cart.go', 17, 'fmt.Println', 'external'),
            ('core/cart.go', 22, 'r.GET', 'no definition'),
            ('shop/api.py', 4, 'Flask', 'external'),
            ('shop/api.py', 7, 'app.get', 'no definition'),
            ('shop/api.py', 12, 'app.route', 'no definition'),
            ('shop/cart.py', 35, 'str', 'no definition'),
            ('shop/cart.py', 41, 'SEEN.append', 'no definition'),
            ('shop/cart.py', 42, 'requests.post', 'external'),
            ('shop/store.py', 12, 'unheard', 'no definition'),
            ('shop/util.py', 5, 'round', 'no definition'),
            ('shop/util.py', 11, 'os.getenv', 'external'),
            ('web/src/api.ts', 15, 'axios.get', 'external'),
        ],
    ),
    "resource_edges": (
        "src VARCHAR, dst VARCHAR, relation VARCHAR",
        [
            ('shop_cart_limit', 'env:SHOP_LIMIT', 'reads'),
            ('shop_util_helper', 'env:SHOP_LIMIT', 'reads'),
        ],
    ),
    "route_edges": (
        "src VARCHAR, dst VARCHAR, relation VARCHAR, confidence VARCHAR",
        [
            ('GET /api/items/{}', 'shop_api_show', 'handles', 'EXTRACTED'),
            ('GET /health', 'core_cart_health', 'handles', 'EXTRACTED'),
            ('POST /api/items/{}', 'shop_api_create', 'handles', 'EXTRACTED'),
            ('shop_cart_add', 'POST /api/items/{}', 'http_calls', 'EXTRACTED'),
            ('web_src_api_load', 'GET /api/items/{}', 'http_calls', 'EXTRACTED'),
        ],
    ),
    "routes_served": (
        "route VARCHAR, handlers BIGINT, callers BIGINT",
        [
            ('GET /api/items/{}', 1, 1),
            ('GET /health', 1, 0),
            ('POST /api/items/{}', 1, 1),
        ],
    ),
    "package_apis": (
        "package VARCHAR, symbol VARCHAR, files BIGINT, uses BIGINT",
        [
            ('axios', 'get', 1, 1),
            ('flask', 'Flask', 1, 1),
            ('fmt', 'Println', 1, 1),
            ('os', 'getenv', 1, 1),
            ('requests', 'post', 1, 1),
            ('std', 'var', 1, 1),
            ('typing', 'TYPE_CHECKING', 1, 1),
        ],
    ),
    "build_report": (
        "part VARCHAR, name VARCHAR, n BIGINT",
        [
            ('calls', 'import', 8),
            ('calls', 'member', 3),
            ('calls', 'scope', 2),
            ('calls', 'unresolved', 12),
            ('edges', 'calls', 15),
            ('edges', 'contains', 24),
            ('edges', 'defines', 4),
            ('edges', 'implements', 1),
            ('edges', 'imports_from', 9),
            ('edges', 'inherits', 1),
            ('edges', 'method', 10),
            ('edges', 'reads', 2),
            ('edges', 'writes', 2),
            ('files', 'go', 1),
            ('files', 'markdown', 1),
            ('files', 'python', 6),
            ('files', 'ts', 2),
            ('nodes', 'class', 4),
            ('nodes', 'constant', 3),
            ('nodes', 'file', 10),
            ('nodes', 'function', 13),
            ('nodes', 'heading', 5),
            ('nodes', 'interface', 1),
            ('nodes', 'method', 10),
            ('nodes', 'struct', 1),
            ('nodes', 'variable', 1),
        ],
    ),
    "build_graph": (
        "relation VARCHAR, confidence VARCHAR, n BIGINT",
        [
            ('calls', 'EXTRACTED', 15),
            ('contains', 'EXTRACTED', 24),
            ('defines', 'EXTRACTED', 4),
            ('handles', 'EXTRACTED', 3),
            ('http_calls', 'EXTRACTED', 2),
            ('implements', 'EXTRACTED', 1),
            ('imports_from', 'EXTRACTED', 9),
            ('inherits', 'EXTRACTED', 1),
            ('method', 'EXTRACTED', 10),
            ('reads', 'EXTRACTED', 4),
            ('writes', 'EXTRACTED', 1),
            ('writes', 'INFERRED', 1),
        ],
    ),
    "allocated_ids": (
        "line INTEGER, name VARCHAR, id VARCHAR",
        [
            (1, 'f', 'f'),
            (5, 'f', 'f__2'),
            (9, 'f', 'f_3'),
            (12, 'f_2', 'f_2'),
            (14, 'F', 'f_4'),
        ],
    ),
    "overloads": (
        "target VARCHAR, line INTEGER, id VARCHAR, confidence VARCHAR",
        [
            ('self.m', 9, 'o_a_m', 'EXTRACTED'),
            ('self.m', 10, 'o_a_m_2', 'EXTRACTED'),
            ('self.m', 11, 'o_a_m', 'INFERRED'),
            ('self.m', 11, 'o_a_m_2', 'INFERRED'),
            ('self.m', 12, 'o_a_m', 'INFERRED'),
            ('self.m', 12, 'o_a_m_2', 'INFERRED'),
        ],
    ),
    "hop_provenance": (
        "id VARCHAR, distance INTEGER, via VARCHAR, relation VARCHAR",
        [("a", 0, None, None), ("b", 1, "a", "calls"), ("c", 1, "a", "calls"), ("d", 2, "b", "calls"), ("e", 2, "c", "calls"), ("f", 3, "e", "calls")],
    ),
    "path_through_diamond": ("step BIGINT, id VARCHAR", [(0, "a"), (1, "c"), (2, "e"), (3, "f")]),
    "small_cycles": ("component VARCHAR, size BIGINT, edges BIGINT", [("a", 3, 3), ("d", 2, 2), ("f", 1, 1)]),
    "two_cliques": ("id VARCHAR, community VARCHAR", [*((f"p{k}", "p0") for k in range(5)), *((f"q{k}", "q0") for k in range(5))]),
    "structural_receivers": (
        "src VARCHAR, dst VARCHAR, relation VARCHAR, confidence VARCHAR",
        [
            ("d_study", "d_book_open", "calls", "INFERRED"),
            ("d_study", "d_book_read", "calls", "INFERRED"),
        ],
    ),
    "definition_kinds": (
        "id VARCHAR, kind VARCHAR",
        [
            ('core_cart_cart', 'class'),
            ('core_cart_cart_total', 'method'),
            ('core_cart_health', 'function'),
            ('core_cart_routes', 'function'),
            ('core_cart_sum', 'function'),
            ('shop_api_create', 'function'),
            ('shop_api_lone_helper_name', 'function'),
            ('shop_api_show', 'function'),
            ('shop_cart_add', 'function'),
            ('shop_cart_base', 'class'),
            ('shop_cart_base_label', 'method'),
            ('shop_cart_base_total', 'method'),
            ('shop_cart_cart', 'class'),
            ('shop_cart_cart_describe', 'method'),
            ('shop_cart_cart_init', 'method'),
            ('shop_cart_cart_raw', 'method'),
            ('shop_cart_cart_total', 'method'),
            ('shop_cart_limit', 'function'),
            ('shop_store_store', 'class'),
            ('shop_store_store_open', 'method'),
            ('shop_store_store_report', 'method'),
            ('shop_util_helper', 'function'),
            ('shop_util_money', 'function'),
            ('tests_test_cart_test_total', 'function'),
            ('web_src_api_item', 'class'),
            ('web_src_api_item_price', 'method'),
            ('web_src_api_load', 'function'),
            ('web_src_api_priced', 'class'),
            ('web_src_format_index_format', 'function'),
        ],
    ),
    "hook_methods": (
        "id VARCHAR, base VARCHAR",
        [
            ('shop_cart_cart_total', 'shop_cart_base'),
        ],
    ),
    "unreferenced_code": (
        "id VARCHAR, kind VARCHAR, mentions BIGINT, note VARCHAR",
        [
            ('core_cart_cart', 'class', 8, 'mentioned'),
            ('core_cart_cart_total', 'method', 0, 'unreferenced'),
            ('core_cart_health', 'function', 2, 'mentioned'),
            ('core_cart_routes', 'function', 0, 'unreferenced'),
            ('shop_cart_base_total', 'method', 3, 'mentioned'),
            ('shop_cart_cart_describe', 'method', 0, 'unreferenced'),
            ('shop_cart_limit', 'function', 0, 'unreferenced'),
            ('shop_store_store_open', 'method', 1, 'mentioned'),
            ('shop_store_store_report', 'method', 0, 'unreferenced'),
            ('shop_util_helper', 'function', 0, 'unreferenced'),
            ('web_src_api_item', 'class', 0, 'unreferenced'),
            ('web_src_api_item_price', 'method', 1, 'mentioned'),
            ('web_src_api_load', 'function', 0, 'unreferenced'),
        ],
    ),
    "similar_bodies": (
        "a VARCHAR, b VARCHAR, score DOUBLE",
        [
            ('core_cart_cart_total', 'shop_cart_base_total', 0.304),
            ('shop_api_create', 'web_src_api_load', 0.314),
            ('shop_api_show', 'web_src_api_load', 0.444),
            ('shop_cart_base', 'shop_store_store', 0.494),
            ('shop_cart_base', 'web_src_api_item', 0.268),
            ('shop_cart_base_label', 'shop_cart_cart_raw', 0.238),
            ('shop_cart_base_label', 'shop_store_store_open', 0.23),
            ('shop_cart_base_total', 'shop_cart_cart_describe', 0.537),
            ('shop_cart_base_total', 'shop_cart_cart_init', 0.281),
            ('shop_cart_base_total', 'shop_cart_cart_raw', 0.368),
            ('shop_cart_base_total', 'shop_cart_cart_total', 0.678),
            ('shop_cart_base_total', 'shop_store_store_open', 0.357),
            ('shop_cart_base_total', 'shop_store_store_report', 0.242),
            ('shop_cart_limit', 'shop_util_helper', 0.598),
            ('shop_store_store', 'web_src_api_item', 0.299),
        ],
    ),
    "did_you_mean": (
        "rank BIGINT, name VARCHAR, why VARCHAR",
        [
            (1, 'AMERICA', 'spelled like'),
            (2, 'AFRICA', 'spelled like'),
        ],
    ),
    "explained": (
        "part VARCHAR, id VARCHAR, relation VARCHAR, n BIGINT",
        [
            ('in', 'core_cart', 'contains', 1),
            ('node', 'core_cart_cart', None, None),
            ('out', 'core_cart_cart_total', 'method', 1),
        ],
    ),
    "module_imports": (
        "src VARCHAR, dst VARCHAR, runs VARCHAR",
        [
            ('shop/__init__.py', 'shop/cart.py', 'module-level'),
            ('shop/__init__.py', 'shop/util.py', 'module-level'),
            ('shop/api.py', 'shop/store.py', 'module-level'),
            ('shop/cart.py', 'shop/store.py', 'type-checking'),
            ('shop/cart.py', 'shop/util.py', 'module-level'),
            ('shop/store.py', 'shop/__init__.py', 'module-level'),
            ('shop/store.py', 'shop/cart.py', 'module-level'),
            ('tests/test_cart.py', 'shop/cart.py', 'module-level'),
            ('web/src/api.ts', 'web/src/format/index.ts', 'module-level'),
        ],
    ),
    "router_prefixes": (
        "router VARCHAR, prefix VARCHAR",
        [
            ('api', '/v1/api'),
            ('api', '/v2/api'),
            ('app', ''),
            ('items', '/v1/api/items'),
            ('items', '/v2/api/items'),
            ('lone', 'lone'),
            ('x', '/x'),
            ('y', ''),
        ],
    ),
    "code_chunks": (
        "cid BIGINT, file VARCHAR, start_line INTEGER, end_line INTEGER, qualname VARCHAR, kind VARCHAR, n_chars INTEGER",
        [
            (0, 'core/cart.go', 1, 7, '', 'module', 60),
            (1, 'core/cart.go', 8, 10, 'Cart', 'definition', 31),
            (2, 'core/cart.go', 12, 14, 'Cart.Total', 'definition', 51),
            (3, 'core/cart.go', 16, 19, 'sum', 'definition', 49),
            (4, 'core/cart.go', 21, 23, 'Routes', 'definition', 56),
            (5, 'core/cart.go', 25, 26, 'health', 'definition', 31),
            (6, 'shop/__init__.py', 1, 2, '', 'window', 54),
            (7, 'shop/api.py', 1, 6, '', 'module', 73),
            (8, 'shop/api.py', 7, 9, 'show', 'definition', 67),
            (9, 'shop/api.py', 12, 14, 'create', 'definition', 95),
            (10, 'shop/api.py', 17, 18, 'lone_helper_name', 'definition', 37),
            (11, 'shop/cart.py', 1, 13, '', 'module', 173),
            (12, 'shop/cart.py', 14, 19, 'Base', 'definition', 12),
            (13, 'shop/cart.py', 15, 16, 'Base.total', 'definition', 37),
            (14, 'shop/cart.py', 18, 19, 'Base.label', 'definition', 42),
            (15, 'shop/cart.py', 22, 35, 'Cart', 'definition', 61),
            (16, 'shop/cart.py', 25, 26, 'Cart.__init__', 'definition', 57),
            (17, 'shop/cart.py', 28, 29, 'Cart.total', 'definition', 53),
            (18, 'shop/cart.py', 31, 32, 'Cart.raw', 'definition', 35),
            (19, 'shop/cart.py', 34, 35, 'Cart.describe', 'definition', 71),
            (20, 'shop/cart.py', 38, 42, 'add', 'definition', 150),
            (21, 'shop/cart.py', 45, 46, 'limit', 'definition', 57),
            (22, 'shop/store.py', 5, 12, 'Store', 'definition', 13),
            (23, 'shop/store.py', 6, 9, 'Store.open', 'definition', 84),
            (24, 'shop/store.py', 11, 12, 'Store.report', 'definition', 47),
            (25, 'shop/util.py', 4, 5, 'money', 'definition', 36),
            (26, 'shop/util.py', 8, 11, 'helper', 'definition', 63),
            (27, 'tests/test_cart.py', 4, 6, 'test_total', 'definition', 69),
        ],
    ),
    "code_tokens": (
        "k INTEGER, terms VARCHAR",
        [
            (0, 'getusername get user nam'),
            (1, 'getusername get user nam'),
            (2, 'getusername get user nam'),
            (3, 'httpserver2x http server'),
            (4, 'pars pars pars'),
            (5, 'v2'),
            (6, 'a12'),
            (7, 'größeänderung'),
            (8, 'class retry bus'),
            (9, 'scop apply'),
            (10, ''),
        ],
    ),
    "query_kinds": (
        "query VARCHAR, kind VARCHAR, terms VARCHAR",
        [
            ('', 'symbol', ''),
            ('CartTotal user_name', 'symbol', 'carttotal cart total username user nam'),
            ('a.b c::d', 'symbol', ''),
            ('f(x) = {y}', 'code', ''),
            ('getUser', 'symbol', 'getuser get user'),
            ('how are carts priced', 'natural', 'cart pric'),
            ('one\ntwo', 'code', 'one two'),
            ('two words', 'natural', 'two word'),
            ('where is the total of a cart', 'natural', 'total cart'),
        ],
    ),
    "exact_names": (
        "boost DOUBLE, n BIGINT",
        [
            (2.0, 4),
            (3.0, 2),
        ],
    ),
    "overlay_terms": (
        "term VARCHAR, file VARCHAR, line INTEGER, tf BIGINT",
        [
            ('add', 'shop/store.py', 6, 1),
            ('add', 'tests/test_cart.py', 4, 1),
            ('cart', 'shop/store.py', 6, 1),
            ('cart', 'tests/test_cart.py', 4, 1),
            ('creat', 'shop/api.py', 17, 1),
            ('describ', 'shop/cart.py', 18, 1),
            ('describ', 'shop/cart.py', 28, 1),
            ('format', 'web/src/api.ts', 9, 1),
            ('helper', 'shop/api.py', 13, 1),
            ('init', 'shop/store.py', 6, 1),
            ('init', 'tests/test_cart.py', 4, 1),
            ('label', 'shop/cart.py', 34, 1),
            ('lon', 'shop/api.py', 13, 1),
            ('lonehelpername', 'shop/api.py', 13, 1),
            ('money', 'shop/cart.py', 28, 1),
            ('money', 'shop/store.py', 6, 1),
            ('nam', 'shop/api.py', 13, 1),
            ('open', 'shop/cart.py', 22, 1),
            ('open', 'shop/cart.py', 25, 1),
            ('open', 'shop/cart.py', 38, 1),
            ('open', 'shop/util.py', 4, 1),
            ('pric', 'web/src/format/index.ts', 1, 1),
            ('raw', 'shop/cart.py', 28, 1),
            ('show', 'shop/store.py', 5, 1),
            ('stor', 'shop/api.py', 8, 1),
            ('sum', 'core/cart.go', 12, 1),
            ('test', 'shop/cart.py', 22, 1),
            ('test', 'shop/cart.py', 25, 1),
            ('test', 'shop/cart.py', 38, 1),
            ('testtotal', 'shop/cart.py', 22, 1),
            ('testtotal', 'shop/cart.py', 25, 1),
            ('testtotal', 'shop/cart.py', 38, 1),
            ('total', 'core/cart.go', 16, 1),
            ('total', 'shop/cart.py', 22, 1),
            ('total', 'shop/cart.py', 25, 1),
            ('total', 'shop/cart.py', 31, 1),
            ('total', 'shop/cart.py', 34, 1),
            ('total', 'shop/cart.py', 38, 1),
            ('total', 'shop/util.py', 4, 1),
        ],
    ),
    "path_priors": (
        "file VARCHAR, plain DOUBLE, asked DOUBLE",
        [
            ('a/demo/tests/x.py', 0.4, 0.5),
            ('examples/a.py', 0.5, 0.5),
            ('src/a.py', 1.0, 1.0),
            ('tests/a.py', 0.4, 1.0),
            ('types/a.d.ts', 0.7, 0.7),
        ],
    ),
    "code_search_symbol": (
        "file VARCHAR, start_line INTEGER, score DOUBLE",
        [
            ('shop/__init__.py', 1, 0.767),
            ('shop/cart.py', 1, 0.0883),
            ('shop/cart.py', 28, 1.3908),
            ('shop/store.py', 6, 1.2944),
            ('shop/util.py', 4, 4.5736),
        ],
    ),
    "code_search_question": (
        "file VARCHAR, start_line INTEGER, score DOUBLE",
        [
            ('core/cart.go', 12, 1.7707),
            ('shop/cart.py', 28, 0.791),
            ('shop/cart.py', 34, 5.1745),
            ('shop/store.py', 6, 0.5977),
            ('tests/test_cart.py', 4, 0.7841),
        ],
    ),
    "locate": (
        "section VARCHAR, id VARCHAR, file VARCHAR, line INTEGER, distance INTEGER",
        [
            ('hidden', 'shop_cart_base_label', 'shop/cart.py', 18, None),
            ('hidden', 'shop_cart_base_total', 'shop/cart.py', 15, None),
            ('hidden', 'shop_cart_cart_raw', 'shop/cart.py', 31, None),
            ('hidden', 'shop_cart_count', 'shop/cart.py', 10, None),
            ('hidden', 'shop_store_store_report', 'shop/store.py', 11, None),
            ('hit', 'shop_util_money', 'shop/util.py', 4, 0),
            ('near', 'shop_cart_cart_total', 'shop/cart.py', 28, 1),
            ('near', 'shop_store_store_open', 'shop/store.py', 6, 1),
            ('near', 'shop_util', 'shop/util.py', 1, 1),
        ],
    ),
    "fetch": (
        "place BIGINT, id VARCHAR, status VARCHAR, file VARCHAR, start_line INTEGER, end_line INTEGER, text VARCHAR",
        [
            (0, 'shop_util_money', 'fetched', 'shop/util.py', 4, 5, 'def money(x):\n    return round(x, 2)'),
            (1, 'shop_cart_cart', 'fetched', 'shop/cart.py', 22, 35, 'class Cart(Base):\n    """What a customer wants to buy."""\n\n    def __init__(self, store):\n        self.store = store\n\n    def total(self):\n        return money(self.raw())\n\n    def raw(self):\n        return 1\n\n    def describe(self):\n        return self.label() + str(self.total())'),
            (2, 'nowhere', 'not_found', None, None, None, None),
            (3, 'shop_cart_add', 'not_fetched', 'shop/cart.py', None, None, None),
            (4, 'docs_guide_use', 'not_fetched', 'docs/guide.md', None, None, None),
        ],
    ),
    "skeleton": (
        "file VARCHAR, def_line INTEGER, qualname VARCHAR, header VARCHAR",
        [
            ('s.py', 2, 'f', '@wraps\ndef f(\n    a,\n    b=(1,),\n):'),
            ('s.py', 9, 'C', 'class C:'),
            ('s.py', 10, 'C.m', '    def m(self): return (\n        1)'),
        ],
    ),
    "git_log": (
        "commit_pos BIGINT, commit VARCHAR, status VARCHAR, old VARCHAR, file VARCHAR",
        [
            (1, 'c5', 'M', None, 'src/b.py'),
            (1, 'c5', 'M', None, 'src/new.py'),
            (2, 'c4', 'M', None, 'src/b.py'),
            (2, 'c4', 'R', 'src/mid.py', 'src/new.py'),
            (3, 'c3', 'A', None, 'src/c.py'),
            (3, 'c3', 'D', None, 'src/gone.py'),
            (3, 'c3', 'M', None, 'src/mid.py'),
            (4, 'c2', 'R', 'src/old.py', 'src/mid.py'),
            (5, 'c1', 'A', None, 'src/b.py'),
            (5, 'c1', 'A', None, 'src/old.py'),
        ],
    ),
    "git_commit_files": (
        "commit VARCHAR, file VARCHAR",
        [
            ('c1', 'src/b.py'),
            ('c1', 'src/new.py'),
            ('c2', 'src/new.py'),
            ('c3', 'src/c.py'),
            ('c3', 'src/new.py'),
            ('c4', 'src/b.py'),
            ('c4', 'src/new.py'),
            ('c5', 'src/b.py'),
            ('c5', 'src/new.py'),
        ],
    ),
    "git_status": (
        "code VARCHAR, file VARCHAR, old VARCHAR",
        [
            (' D', 'src/gone.py', None),
            (' M', 'src/a.py', None),
            ('??', 'notes.txt', None),
            ('R ', 'src/new.py', 'src/R  old.py'),
        ],
    ),
    "structural_diff": (
        "kind VARCHAR, old VARCHAR, file VARCHAR, structural BOOLEAN",
        [
            ('added', 'D', 'D', True),
            ('modified', 'src/a.py', 'src/a.py', False),
            ('modified', 'src/b.js', 'src/b.js', False),
            ('removed', 'src/gone.py', 'src/gone.py', True),
            ('renamed', 'src/old.py', 'src/new.py', True),
        ],
    ),
    "freshness": (
        "action VARCHAR, stale BOOLEAN, structural BIGINT, cosmetic BIGINT, phantom BIGINT, ignored BIGINT, case VARCHAR",
        [
            ('fresh', False, 0, 0, 0, 0, 'nothing'),
            ('fresh', False, 0, 0, 0, 0, 'unknown'),
            ('fresh', False, 0, 2, 0, 1, 'comments'),
            ('rebuild', True, 0, 0, 0, 0, 'unreachable'),
            ('rebuild', True, 0, 0, 1, 0, 'removed'),
            ('update', True, 1, 0, 0, 0, 'edit'),
        ],
    ),
    "changes_judged": (
        "file VARCHAR, change VARCHAR",
        [
            ('D', 'new'),
            ('src/a.py', 'cosmetic'),
            ('src/b.js', 'cosmetic'),
            ('src/c.js', 'structural'),
            ('src/gone.py', 'removed'),
            ('src/new.py', 'new'),
        ],
    ),
    "project_walk": (
        "file VARCHAR, status VARCHAR",
        [
            ('.git/x.py', 'hidden'),
            ('app/routes/web.php', 'read'),
            ('app/urls.py', 'read'),
            ('config/routes.rb', 'read'),
            ('docs/e.md', 'read'),
            ('env1/lib/f.py', 'environment'),
            ('env1/pyvenv.cfg', 'environment'),
            ('lib/d.min.js', 'ignored'),
            ('logo.png', 'unknown'),
            ('node_modules/m/i.js', 'read'),
            ('src/a.py', 'read'),
            ('src/build/b.py', 'ignored'),
            ('src/gen/g.py', 'ignored'),
            ('src/gen/keep.py', 'read'),
            ('src/huge.py', 'too_large'),
            ('src/keep/build/c.py', 'read'),
        ],
    ),
    "search_walk": (
        "file VARCHAR",
        [
            ('app/routes/web.php',),
            ('app/urls.py',),
            ('config/routes.rb',),
            ('docs/e.md',),
            ('env1/lib/f.py',),
            ('lib/d.min.js',),
            ('node_modules/m/i.js',),
            ('src/a.py',),
            ('src/gen/g.py',),
            ('src/gen/keep.py',),
            ('src/huge.py',),
        ],
    ),
    "route_candidates": (
        "file VARCHAR",
        [
            ('app/routes/web.php',),
            ('config/routes.rb',),
        ],
    ),
    "relevant_files": (
        "file VARCHAR",
        [
            ('.git/x.py',),
            ('app/routes/web.php',),
            ('app/urls.py',),
            ('config/routes.rb',),
            ('docs/e.md',),
            ('env1/lib/f.py',),
            ('lib/d.min.js',),
            ('logo.png',),
            ('node_modules/m/i.js',),
            ('src/a.py',),
            ('src/build/b.py',),
            ('src/gen/g.py',),
            ('src/gen/keep.py',),
            ('src/huge.py',),
            ('src/keep/build/c.py',),
        ],
    ),
    "source_lines": (
        "file VARCHAR, lo INTEGER, hi INTEGER, line INTEGER, text VARCHAR",
        [
            ('shop/../shop/util.py', 11, 99, 11, '    return os.getenv("SHOP_LIMIT")'),
            ('shop/../shop/util.py', 11, 99, 12, ''),
            ('shop/./util.py', 0, 2, 1, 'LIMIT = 10'),
            ('shop/./util.py', 0, 2, 2, ''),
        ],
    ),
    "saved_labels": (
        "community BIGINT, name VARCHAR, rejected BOOLEAN",
        [
            (1, 'One', False),
            (2, 'Zwei', False),
            (9, None, True),
        ],
    ),
    "static_vectors": (
        "key VARCHAR, x DOUBLE, y DOUBLE",
        [
            ('a', 0.7071, 0.7071),
            ('b', 0.8944, 0.4472),
        ],
    ),
    "json_graph": (
        "part VARCHAR, pos BIGINT, a VARCHAR, b VARCHAR, file VARCHAR, kind VARCHAR, n BIGINT, line INTEGER, external BOOLEAN",
        [
            ('edge', 0, '0', 'b', None, 'calls', None, None, None),
            ('edge', 1, 'b', 'C', None, 'uses', None, None, None),
            ('edge', 2, '?', '?', None, '->', None, None, None),
            ('node', 0, '0', 'Zero', 'a/z.py', 'code', 3, 12, False),
            ('node', 1, 'b', 'B', '', '', None, 7, True),
            ('node', 2, 'C', 'C', '', '', None, None, False),
        ],
    ),
    "other_hashes": (
        "x VARCHAR, fnv VARCHAR, blake VARCHAR",
        [
            ('', 'cbf29ce484222325', 'e4a6a0577479b2b4'),
            ('a', 'af63dc4c8601ec8c', '40f89e395b66422f'),
            ('foobar', '85944171f73967e8', '9d212f7f254a51f9'),
            (None, None, None),
        ],
    ),
    "member_signatures": (
        "g BIGINT, n BIGINT, signature VARCHAR",
        [
            (1, 2, 'e5d29919042666b2'),
            (2, 1, 'e5d29919042666b2'),
        ],
    ),
}
