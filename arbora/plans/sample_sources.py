"""Source texts of the web frameworks that the engine knows, with what must come out of them.

Queries over these texts run beside those over documents, so that every framework's rules meet some rows.
"""

from __future__ import annotations

SOURCES: list[tuple[str, str]] = [
    ("/s/express/app.js", "app.get('/u/:id', auth, users.show);\nrouter.post('/u', users.create);\n"),
    ("/s/nest/cats.controller.ts", "@Controller('cats') class C { @Get(':id') find(a) {} }\nclass E { @MessagePattern('sum') add(x) {} }\n"),
    ("/s/flask/app.py", "@app.route('/x', methods=['POST'])\ndef go(): pass\n"),
    ("/s/fastapi/api.py", "@r.get('/y')\nasync def y(): pass\n"),
    ("/s/django/urls.py", "urlpatterns = [path('a/', views.home)]\n"),
    ("/s/rails/routes.rb", "  get '/a', to: 'users#show'\n"),
    ("/s/spring/A.java", '@RequestMapping("/api") public class A { @GetMapping("/x") public String x(int a) { } }\n'),
    ("/s/aspnet/Users.cs", '[Route("api/[controller]")] public class UsersController { [HttpGet("[action]")] public int ListAll() { } }\n'),
    ("/s/aspnet/Program.cs", 'app.MapHub<Chat.ChatHub>("/chat");\n'),
    ("/s/gin/main.go", 'v := r.Group("/v1")\nv.GET("/p", h.Ping)\n'),
    ("/s/laravel/web.php", "Route::post('/a', [AController::class, 'store']);\n"),
    ("/s/vapor/routes.swift", 'app.get("a", "b", use: c.list)\n'),
    ("/s/next/pages/blog/[id].tsx", "export default function Page() { return null }\n"),
    ("/s/angular/a.component.ts", "@Component({ selector: 'a-b' })\nexport class AComponent { }\n"),
    ("/s/react/card.tsx", "export function Card(p) { return <div/>; }\n"),
    ("/s/kit/src/routes/(app)/blog/[slug]/+server.ts", "export async function GET() {}\n"),
]

#: (file_path, line, verb, path, handler, framework), read off the texts by hand.
ROUTES: list[tuple[str, int, str, str, str, str]] = [
    ("/s/express/app.js", 1, "GET", "/u/:id", "show", "express"), ("/s/express/app.js", 2, "POST", "/u", "create", "express"),
    ("/s/nest/cats.controller.ts", 1, "GET", "/cats/:id", "find", "nestjs"), ("/s/nest/cats.controller.ts", 2, "MESSAGE", "sum", "add", "nestjs"),
    ("/s/flask/app.py", 1, "POST", "/x", "go", "flask"), ("/s/fastapi/api.py", 1, "GET", "/y", "y", "fastapi"), ("/s/django/urls.py", 1, "ANY", "/a", "home", "django"),
    ("/s/rails/routes.rb", 1, "GET", "/a", "users#show", "rails"), ("/s/spring/A.java", 1, "ANY", "/api", "x", "spring"), ("/s/spring/A.java", 1, "GET", "/x", "x", "spring"),
    ("/s/aspnet/Users.cs", 1, "GET", "/api/users/list-all", "ListAll", "aspnet"), ("/s/aspnet/Program.cs", 1, "HUB", "/chat", "ChatHub", "aspnet"),
    ("/s/gin/main.go", 2, "GET", "/v1/p", "Ping", "go"), ("/s/laravel/web.php", 1, "POST", "/a", "store", "laravel"), ("/s/vapor/routes.swift", 1, "GET", "/a/b", "list", "vapor"),
    ("/s/next/pages/blog/[id].tsx", 1, "GET", "/blog/:id", "default", "files"),
]
#: (file_path, line, kind, name, framework)
DECLARATIONS: list[tuple[str, int, str, str, str]] = [
    ("/s/angular/a.component.ts", 1, "component", "AComponent", "angular"), ("/s/react/card.tsx", 1, "component", "Card", "react"),
    ("/s/kit/src/routes/(app)/blog/[slug]/+server.ts", 1, "route", "/blog/:slug", "svelte"), ("/s/kit/src/routes/(app)/blog/[slug]/+server.ts", 1, "route", "GET /blog/:slug", "svelte"),
]


def values(rows: list[tuple], columns: str) -> str:
    """The rows as a query in SQL."""
    cell = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({columns})"
