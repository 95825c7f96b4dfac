"""Small rule corpora, written by tests."""

CLINIC = """<?xml version="1.0" encoding="UTF-8"?>
<Project Name="Clinic Hub" eid="P1">
  <!-- <Rule RuleClassName="x.InvokeIRISRule" ResourcePath="hidden"/> -->
  <DataSources>
    <DataSource Name="Patient Feed" ClassType="a.ODataSource" ServiceRootUri="https://hub.test/odata/"/>
    <DataSource Name="Booking" ClassType="a.SwaggerSource" EndPointURL="https://hub.test/v2"/>
  </DataSources>
  <Products>
    <Product Name="FindPatient" eid="PR1" InitialPhase="FindPatient.Go"
      Name_ClassType="m" Name_ExportedProperty="FindPatient[1].Out[1].Name" Name_PropertyKey="Out.Name" Name_PubOut="Y">
      <Phase Name="Go" eid="PH1">
        <Rule Name="Load patient" eid="R1" RuleClassName="a.b.InvokeIRISRule" IRISSource="Patient feed" IRISAction="GET"
          ResourcePath="/patients" QueryInputDataGroup="FindPatient[1].In[1]" ResultsDataGroup="FindPatient[1].Out[1]"/>
      </Phase>
    </Product>
    <Product Name="Book" eid="PR2" Slot_ExportedProperty="Book[1].Slot" Slot_PropertyKey="Slot" Slot_PubIn="Y" Slot_PubOut="Y">
      <Phase Name="Send" eid="PH2">
        <Rule Name="Gate" RuleClassName="EvaluateRule" RuleDisabled="y"><Rule Name="Post slot" eid="R2" RuleClassName="SwaggerIntegrationRule"
          SourceName="Booking" HTTPMethod="POST" ResourcePath="slots" Input="Book[1].Req"/></Rule>
      </Phase>
    </Product>
  </Products>
</Project>
"""
DESK = """<Project><Rules>
  <Rule Name="Ask hub" eid="C1" RuleClassName="x.CallComponentRule" SelectComponent="lib\\ClinicHub.ifp" ComponentList="FindPatient"
    Id_SolutionDataItemMapping="Desk.Id" Id_PropertyKey="In.Id" Id_In="Y" Nm_SolutionDataItemMapping="Desk.Name" Nm_PropertyKey="Out.Name" Nm_Out="Y"/>
  <Rule Name="Book it" eid="C2" RuleClassName="CallComponentRule" SelectComponent="lib/ClinicHub.ifp" ComponentList="hub/Book/"
    S_SolutionDataItemMapping="Desk.Slot" S_PropertyKey="Slot" S_In="Y" S_Out="Y"/>
</Rules></Project>"""
OLD = """<Phase Name="Old"><Rule Name="Legacy" RuleClassName="HouseRule" ComponentPath="lib/ClinicHub.ifp" ComponentList="Nowhere"/>
<Rule RuleClassName="HouseRule" Note="see lib/ClinicHub.ifp"/><Button Text="lib/ClinicHub.ifp"/></Phase>"""
PLAIN = "<Phase><!-- lib/ClinicHub.ifp --><Rule Name='none' RuleClassName='GotoRule'/></Phase>"


def clinic(folder) -> str:
    (folder / "lib").mkdir(parents=True)
    (folder / "lib" / "ClinicHub.ifp").write_text(CLINIC, encoding="utf-8")
    (folder / "Desk.IFP").write_text(DESK, encoding="utf-8")
    (folder / "old.ifp").write_bytes(b"\xff\xfe" + OLD.encode("utf-16-le"))
    (folder / "plain.ifp").write_text(PLAIN, encoding="utf-8")
    (folder / "notes.txt").write_text("lib/ClinicHub.ifp", encoding="utf-8")
    return str(folder)


SCREEN = """<Project><Products><Product Name="Screen"><Phase Name="Main" eid="M">
  <Rule Name="Init" eid="S0" RuleClassName="SetValueRule" PropertyName="Desk.Id" FromValue="42"/>
  <Rule Name="Gate" eid="S1" RuleClassName="EvaluateRule" Expression="$$Desk.Id$ == '42'">
    <Rule Name="Yes" eid="S2" RuleType="True" RuleClassName="CallComponentRule" SelectComponent="Api.ifp" ComponentList="Find"
      I_SolutionDataItemMapping="Desk.Id" I_PropertyKey="Find[1].Id" I_In="Y" N_SolutionDataItemMapping="Desk.Name" N_PropertyKey="Find[1].Out.Name" N_Out="true"/>
    <Rule Name="No" eid="S3" RuleType="False" RuleClassName="SetValueRule" PropertyName="Desk.Name" FromValue="nobody"/>
    <Rule Name="Odd" eid="S4" RuleType="Maybe" RuleClassName="SetValueRule" PropertyName="Desk.Other" FromValue="x"/>
  </Rule>
  <Rule Name="Show" eid="S5" RuleClassName="SetValueRule" PropertyName="Desk.Title" FromValue="Dr $$Desk.Name$"/>
  <Rule Name="Unused" eid="S6" RuleClassName="SetValueRule" PropertyName="Desk.Unused" FromValue="1"/>
</Phase></Product></Products></Project>"""
API = """<Project><DataSources><DataSource Name="Feed" ServiceRootUri="https://hub.test"/></DataSources><Products>
 <Product Name="Find" InitialPhase="Find.Run"><Phase Name="Run">
  <Rule Name="Get" eid="A1" RuleClassName="z.InvokeIRISRule" IRISSource="Feed" IRISAction="GET" ResourcePath="/p/$%IF Find[1].Id == '1'$one$%ELSE$$$Find[1].Id$$%ENDIF$" ResultsDataGroup="Find[1].Out"/>
 </Phase></Product></Products></Project>"""


def lineage(folder) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "Screen.ifp").write_text(SCREEN, encoding="utf-8")
    (folder / "Api.ifp").write_text(API, encoding="utf-8")
    return str(folder)
