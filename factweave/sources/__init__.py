"""factweave.sources"""
