"""Readers of build, configuration and deployment files."""

from weftgraph.sources import build_files as B


def files(spark, tmp_path, **texts):
    for name, text in texts.items():
        at = tmp_path / name.replace("__", "/").replace("_dot_", ".")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return B.whole_files(spark, f"file://{tmp_path}/*/*")


def test_maven(spark, tmp_path):
    f = files(spark, tmp_path, top__pom_dot_xml='<project xmlns="http://m"><artifactId>top</artifactId><packaging>pom</packaging><modules><module>../web</module></modules></project>', web__pom_dot_xml="<project><artifactId>web</artifactId></project>")
    got = {r.artifact: (r.packaging, r.modules) for r in B.read_maven(f).collect()}
    assert got == {"top": ("pom", ["../web"]), "web": ("jar", [])}
    assert [(r.artifact, r.packaging) for r in B.leaf_modules(f).collect()] == [("web", "jar")]


def test_gradle(spark, tmp_path):
    f = files(spark, tmp_path, g__settings_dot_gradle="rootProject.name='x'\ninclude 'a', \"b:c\"\n  include('d')\n", g__build_dot_gradle="plugins {\n  id 'war'\n  id(\"org.springframework.boot\")\n  java\n}\n")
    assert sorted(r.include for r in B.read_gradle_includes(f.where("name like 'settings%'")).collect()) == ["a", "b:c", "d"]
    r = B.read_gradle_plugins(f.where("name like 'build%'")).first()
    assert (r.plugins, r.packaging) == (["java", "org.springframework.boot", "war"], "war")


def test_persistence(spark, tmp_path):
    f = files(spark, tmp_path, m__persistence_dot_xml='<?xml version="1.0"?><persistence xmlns="u"><persistence-unit name="a"><jta-data-source>java:/x</jta-data-source><class>A</class><class>B</class></persistence-unit><persistence-unit name="b"></persistence-unit></persistence>')
    assert {r.unit: (r.datasource, r.classes) for r in B.read_persistence_xml(f).collect()} == {"a": ("java:/x", ["A", "B"]), "b": (None, [])}


def test_configuration_precedence(spark, tmp_path):
    f = files(spark, tmp_path, m__application_dot_properties="a.b=1\n# no\nc = two\na.b=3\n", m__application_dot_yaml="a:\n  b: 4\n  on: true\nlist: [1, x]\nnone:\n", m__application_dot_yml="c: three\n", n__application_dot_yml="- no mapping\n", o__application_dot_yaml="a: [unclosed\n")
    got = {r.key: (r.value, r.source) for r in B.read_config(f).collect()}
    assert got == {"a.b": ("4", "application.yaml"), "a.true": ("true", "application.yaml"), "list": ("[1, x]", "application.yaml"), "c": ("three", "application.yml")}


def test_compose_and_playbooks(spark, tmp_path):
    f = files(spark, tmp_path, d__docker_dash_compose_dot_yml="services:\n  order-api:\n    ports: ['80:80', 443]\n    depends_on:\n      db: {condition: x}\n  db:\n    depends_on: [disk]\n  odd:\n", p__site_dot_yml="- hosts: web\n  roles: [nginx, {role: app, x: 1}]\n- hosts: db\n")
    got = {r.service: (r.ports, r.depends_on) for r in B.read_compose(f.where("folder like '%/d'")).collect()}
    assert got == {"order-api": (["80:80", "443"], ["db"]), "db": ([], ["disk"]), "odd": ([], [])}
    apps = spark.createDataFrame([("app:1", "Order"), ("app:2", "billing")], "id string, name string")
    assert [(r.service, r.app_id) for r in B.deployments(B.read_compose(f.where("folder like '%/d'")), apps).collect()] == [("order-api", "app:1")]
    assert {(r.hosts, r.role) for r in B.read_playbooks(f.where("folder like '%/p'")).collect()} == {("web", "nginx"), ("web", "app")}
